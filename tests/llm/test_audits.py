"""Passage removal, source divergence and filter interaction against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigvane.llm import divergence, filter_audit, queries, substring_dedup

# Extra columns take names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, substring_dedup string, owner long, part string, passage_tie string, n long, term string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, "p", "y", 2, "z") for i, t, lang, source in rows], SCHEMA)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def some_documents():
    passage, other = prose(1, 45, 10_000), prose(2, 20, 10_000)
    rows = [
        (5, f"{prose(3, 30)} {passage} {prose(4, 30)}", "en", "a"), (2, f"{passage}\n{other}", "en", "b"), (9, f"x {other} y\t{passage[:200]}", "de", "a"),
        (1, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "", "b"), (7, prose(5, 19), "de", "c"), (8, "la " * 3000, "de", "a"), (6, "la " * 25, "en", "b"),
        (10, "Größe ÄRE ähnlich 5G é " * 12, "de", "b"), (11, "Größe ÄRE ähnlich 5G é " * 12, "de", "b"), (11, "Größe ÄRE ähnlich 5G é " * 12, "de", "b"),
        (12, passage + " left", "fr", "a"), (12, "right " + passage, "fr", "a"), (None, other + " tail", "fr", None), (None, other + " tail", "fr", None), (None, other + " more", "en", "c"),
        (13, f"{passage} {prose(6, 4000)} {passage} {passage}", "en", "a"), (14, "A B C D E F G H I J " * 12, "en", "d"), (15, "100% & more | or less " * 30, "en", "d"),
        (16, prose(7, 400, 5000), "en", "d"), (17, prose(7, 400, 5000), "de", "d"), (18, "a\x0bb\x0cc\x1fd\x85e f\x00g " * 10, "es", "only"),
    ]
    return rows


def passages_removed(spark, rows):
    """Word by word, with the order of documents that the docstring gives."""
    texts = spark.createDataFrame([(t,) for t in {t or "" for _, t, _, _ in rows}], "t string")
    key = {r["t"]: r["k"] for r in texts.selectExpr("t", "CAST(pmod(xxhash64(t), 2147483647) AS INT) AS k").collect()}
    documents = {(substring_dedup.NO_ID if i is None else i, key[t or ""]): (t or "").encode().split() for i, t, _, _ in rows}
    seen, gone = set(), {d: set() for d in documents}
    for d in sorted(documents):
        words = documents[d]
        for s in range(len(words) - substring_dedup.WINDOW + 1):
            window = tuple(words[s : s + substring_dedup.WINDOW])
            if window in seen:
                gone[d].update(range(s, s + substring_dedup.WINDOW))
            seen.add(window)
    out = []
    for i, t, _, _ in rows:
        d = (substring_dedup.NO_ID if i is None else i, key[t or ""])
        out.append((i, b" ".join(w for k, w in enumerate(documents[d]) if k not in gone[d]).decode(), len(documents[d]), len(gone[d])))
    return Counter(out)


def test_passages_that_start_earlier_go(spark):
    rows = some_documents()
    found = substring_dedup.drop_repeated_passages(frame(spark, rows).repartition(3))
    found_rows = Counter((r["doc_id"], r["substring_dedup_"]["text"], r["substring_dedup_"]["n_words"], r["substring_dedup_"]["n_removed"]) for r in found.collect())
    assert found_rows == passages_removed(spark, rows)
    assert {"owner", "passage_tie", "substring_dedup"} <= set(found.columns)


@pytest.mark.parametrize(("stretch", "shard", "lane"), [(300, 500, 3), (1 << 20, 1 << 20, 12)])
def test_passages_do_not_depend_on_stretches_shards_and_lanes(spark, monkeypatch, stretch, shard, lane):
    """In one process: the functions that the tasks run, seven documents at a time."""
    rng = random.Random(stretch)
    texts = []
    for i in range(60):
        words = [f"v{rng.randrange(4 if i % 3 else 500)}" for _ in range(rng.randrange(120))]
        if texts and i % 2:
            other = texts[rng.randrange(len(texts))].split()
            words[rng.randrange(len(words) + 1) : 0] = other[rng.randrange(len(other) + 1) :]
        texts.append(" ".join(words))
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    for name, value in (("SHARD", shard), ("LANE", lane), ("STRETCH", stretch)):
        monkeypatch.setattr(substring_dedup, name, value)
    _, hashes = substring_dedup.words_of(" ".join(texts).encode())
    codes, hot = substring_dedup.Codes(np.unique(hashes)[:100]), np.zeros(1 << substring_dedup.BUCKET_BITS, bool)
    batches = [b for i in range(0, 60, 7) for b in substring_dedup.cut([(k, 0, t.encode()) for k, t in enumerate(texts)][i : i + 7], codes, hot, 1 + 60 * 60 // shard)]
    table = pa.Table.from_batches(batches)
    gone = defaultdict(set)
    for s in set(table["shard"].to_pylist()):
        for r in substring_dedup._searched(table.filter(pa.compute.equal(table["shard"], s))).to_pylist():
            gone[r["owner"]].update(range(r["start"], r["stop"]))
    expected = {i: n for (i, _, _, n), _ in passages_removed(spark, rows).items()}
    assert {i: len(gone[i]) for i in range(60)} == expected and sum(expected.values()) > 500


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_index_finds_what_is_there(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters + 1, 900)
    text[-1] = 0
    text = np.unique(text, return_inverse=True)[1]
    width = 4
    index = substring_dedup.FMIndex(text, width)
    whole = [s for s in range(len(text) - width) if (text[s : s + width] > 0).all()]
    places = defaultdict(list)
    for s in whole:
        places[tuple(text[s : s + width])].append(s)
    first, last = np.array(whole), np.array(whole)
    found = dict(zip(*[x.tolist() for x in index.repeated(first, last, width)], strict=True))
    assert found == {s: p[0] for p in places.values() if len(p) > 1 for s in p}
    # Intervals of shorter patterns count them.
    for s in whole[:50]:
        low, high = np.array([index.starts[text[s + 2]]]), np.array([index.starts[text[s + 2] + 1]])
        for k in (1, 0):
            low, high = index.extended(low, high, text[s + k : s + k + 1])
        assert high[0] - low[0] == sum((text[i : i + 3] == text[s : s + 3]).all() for i in range(len(text) - 2))


def test_rare_words_keep_their_places_among_frequent_ones():
    words = substring_dedup.words_of
    codes = substring_dedup.Codes(words(b"a b")[1])
    pieces = [codes.units(words(line)[1])[0].tobytes() for line in (b"a rare b", b"rare", b"b other rare a")]
    found = substring_dedup.symbols(pieces).tolist()
    assert [x == 0 for x in found] == [False, False, False, True, False, True, False, False, False, False, True]
    assert found[1] == found[4] == found[8] != found[7] and found[0] == found[9] and found[2] == found[6]


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_equal_words_have_equal_hashes(monkeypatch, stretch):
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    raw = " ".join(["a", "ab", "b", "", "ba", "a", "x" * 50, "ab\tab\x0bé\x1f", "é\x1f", "x" * 50 + "y"] * 3).encode()
    starts, hashes = substring_dedup.words_of(raw)
    listed = raw.split()
    assert [raw[s : s + len(w)] for s, w in zip(starts, listed, strict=True)] == listed
    assert len({(w, int(h)) for w, h in zip(listed, hashes, strict=True)}) == len(set(listed)) == len(set(hashes.tolist()))
    assert len(substring_dedup.words_of(b" \n")[0]) == len(substring_dedup.words_of(b"")[0]) == 0


def divergences(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lowered = [(lang or "", source or "", ["".join(c.lower() if c.isascii() else c for c in t) for t in term.findall(text or "")]) for _, text, lang, source in rows]
    often, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in lowered:
        often[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = set()
    for lang in {x for x, _ in counts}:
        kept = sorted(t for t, n in often[lang].items() if n >= least)
        sources = sorted(s for x, s in counts if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        shares = {s: share(counts[lang, s]) for s in sources}
        of_all = share(whole)
        for s in sources:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(shares[s][t] - of_all[t], t) for t in kept if counts[lang, s][t] and shares[s][t] > of_all[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(1, 3, 8), (2, 50, 1 << 15), (10_000, 5, 100)])
def test_divergence_of_sources(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    rows = some_documents()
    found = divergence.audit(frame(spark, rows), least, top)
    listed = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(listed) == len(set(listed)) and set(listed) == divergences(rows, least, top)


def test_equal_subtrees_are_one_node():
    tree, place, count = np.repeat(np.arange(3), 8), np.tile(np.arange(8), 3), np.array([1, 2, 1, 2, 1, 2, 1, 2] * 2 + [1, 2, 1, 2, 1, 2, 9, 2])
    forest = divergence.Forest(tree, place, count, 3, 8)
    assert forest.roots[0] == forest.roots[1] != forest.roots[2]
    assert [len(c) for c in forest.children] == [3, 3, 3]  # zeros among them
    pair, x, y, times = forest.met_counts(np.array([0, 0]), np.array([1, 2]))
    assert sorted(zip(pair.tolist(), x.tolist(), y.tolist(), times.tolist(), strict=True)) == [(0, 1, 1, 4), (0, 2, 2, 4), (1, 1, 1, 3), (1, 1, 9, 1), (1, 2, 2, 4)]


def test_shares_are_exact_beyond_64_bits():
    counts, totals = np.array([0, 5 * 10**15]), np.array([10**16, 10**16])
    assert divergence.shares(counts, totals, 7).tolist() == [1 + 5 * 10**9 // (10**16 + 35), 1 + 10**9 * (5 * 10**15 + 5) // (10**16 + 35)]


LABELS = [(5, 1, 0), (14, 0, 1), (14, 0, 0), (17, 1, 1), (None, 1, 1), (16, None, 1), (99, 1, 1), (3, 1, 0)]


def interactions(rows, labels):
    said = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            said[i] = [max(said[i][0], int(quality == 1)), max(said[i][1], int(toxic == 1))]
    documents = defaultdict(list)
    for i, text, lang, _ in rows:
        text = text or ""
        words = text.encode().split()
        smaller = [j for j, t, _, _ in rows if (t or "") == text and j is not None and (i is None or j < i)]
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(smaller),
        }
        documents[lang or ""].append(({f for f in failed if failed[f]}, *said.get(i, (0, 0))))
    out = []
    for part, some in documents.items():
        total = Counter()
        cells = []
        for order in permutations("ABCDE"):
            gone = [False] * len(some)
            for step, letter in enumerate(order, 1):
                here = [k for k, (fails, _, _) in enumerate(some) if letter in fails and not gone[k]]
                redundant = sum(letter in fails and gone[k] for k, (fails, _, _) in enumerate(some))
                for k in here:
                    gone[k] = True
                total[letter] += len(here)
                cells.append((part, "".join(order), step, gone.count(False), len(here), redundant, sum(fails == {letter} for fails, _, _ in some), sum(some[k][1] for k in here), sum(some[k][2] for k in here)))
        out += [(*c, total[c[1][c[2] - 1]]) for c in cells]
    return sorted(out)


def test_filters_in_every_order(spark):
    rows = some_documents()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(frame(spark, rows), labels)
    assert sorted(map(tuple, found.collect())) == interactions(rows, LABELS)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_prefixes_cover_every_rank_once_at_each_step():
    for step in range(1, 6):
        spans = sorted((start, stop) for _, _, s, start, stop in filter_audit.prefixes() if s == step)
        assert spans[0][0] == 0 and spans[-1][1] == 120 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for letter, before, step, start, stop in filter_audit.prefixes():
        for order in filter_audit.ORDERS[start:stop]:
            assert order[step - 1] == letter and sum(map(filter_audit.bit, order[: step - 1])) == before


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_dedup.drop_repeated_passages(none).count() == divergence.audit(none).count() == filter_audit.audit(none, labels).count() == 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_source_divergence", "op13_filter_audit"])
def test_query_equals_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb
    from check_oracle import compare

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    status, _, _, note = compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], sf_dir)
    assert status == "ok", note


def test_kept_text_of_a_whole_table(spark, sf_dir):
    """The digest of the query is that of the operator's text."""
    rows = queries.op11_substring_dedup(spark, sf_dir).where("n_removed > 0").orderBy("doc_id").limit(5).collect()
    docs = substring_dedup.drop_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(F.col("doc_id").isin([r["doc_id"] for r in rows])).orderBy("doc_id").collect()
    assert [hashlib.sha256(d["substring_dedup"]["text"].encode()).hexdigest() for d in docs] == [r["kept_sha256"] for r in rows]
