"""Line deduplication, near-duplicate classes and fingerprints against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigvane.llm import fingerprints, line_dedup, near_dedup
from sigvane.llm.common import WordHashes

SCHEMA = "doc_id long, text string, line_dedup string, owner long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def frame(spark, rows):
    """Rows (doc_id, text) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


LINES = [
    (3, "A shared line here\nonly in three\nshort\nA shared line here"), (1, "  a SHARED line here\t\nshort\nfirst of all lines"),
    (2, None), (5, ""), (7, "\n\n"), (9, "first of all lines\n" * 300 + "the last line of nine"), (None, "first of all lines\nline without an id"),
    (4, "Ünïcode lines stay\nlower ÄRE not A-Z"), (6, "Ünïcode lines stay\nlower äre not a-z"), (8, "123456789\n1234567890"), (10, "123456789\n1234567890"),
    (11, "same row twice"), (11, "same row twice"),
]


def kept_lines(rows):
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    place = lambda i: float("inf") if i is None else i
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), float("inf")), place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if len(key(line)) < 10 or owner[key(line)] == place(i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines_stay_in_their_smallest_document(spark, batches, fanout):
    df = line_dedup.drop_repeated_lines(frame(spark, LINES), batches, fanout)
    found = Counter((r["doc_id"], r["line_dedup_"]["text"], r["line_dedup_"]["n_lines"], r["line_dedup_"]["n_dropped"]) for r in df.collect())
    assert found == kept_lines(LINES)
    assert {"line_dedup", "owner"} <= set(df.columns)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_rows_without_id_are_documents_of_their_own(spark):
    shared = "a line that every row without an id holds"
    rows = [(1, "held by the document with an id"), *[(None, f"{shared}\nheld by the document with an id\nonly in row {i:04d}") for i in range(40)], (None, shared), (None, shared)]
    docs = frame(spark, rows)
    out = line_dedup.drop_repeated_lines(docs).collect()
    assert Counter(line for r in out for line in r["line_dedup_"]["text"].split("\n") if line) == Counter({line for _, t in rows for line in t.split("\n")})
    assert len(out) == len(rows) and sum(r["line_dedup_"]["n_dropped"] for r in out) == 41 + 40
    placed = line_dedup._placed(docs, "owner", "place")
    held = line_dedup.owned_keys(placed.select("owner", "place", "text")).groupBy("owner", "place").count().agg(F.max("count")).first()[0]
    assert held <= 3


def test_no_lines_of_no_documents(spark):
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def near_rows():
    rng = random.Random(4)
    rows = [(i, prose(i, 120)) for i in range(30)]
    for i in range(12):  # one word changed
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rows[3][1].replace(" ", "\n", 1)) for i in range(6)]
    chain = prose("chain", 150).split()  # each like the one before, the ends unlike
    for i in range(12):
        chain[10 * i : 10 * i + 2] = [f"c{i}", f"d{i}"]
        rows.append((300 + i, " ".join(chain)))
    return [*rows, (400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "one  two"), (405, "two one"), (None, "one two"), (500, prose("long", 9000))]


def brute_classes(rows):
    cache = WordHashes()
    sets = {i: near_dedup.shingles((t or "").encode(), cache) for i, t in rows if i is not None}
    label = {i: i for i in sets}

    def top(x):
        return x if label[x] == x else top(label[x])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            empty = not len(sets[a][0]) and not len(sets[b][0])
            if empty or near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    df = near_dedup.classes(frame(spark, [*rows, rows[5]]))
    assert {r["doc_id"]: r["class_id"] for r in df.collect()} == brute_classes(rows) | {None: 403}
    assert near_dedup.classes(frame(spark, [])).count() == 0


def test_one_document_of_each_class_stays(spark):
    rows = near_rows()
    kept = near_dedup.keep_one(frame(spark, [*rows, rows[5], (None, "one two")]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter(set(brute_classes(rows).values()))


def mixed_rows():
    """Ids with several texts, and rows without an id, whose links go by one text or another."""
    a, b, c = prose("a", 60), prose("b", 60), prose("c", 60)
    return [
        (1, a), (1, b), (2, b + " more"), (1, c), (9, "less " + c), (None, b), (None, b + " less"), (None, prose("d", 60)), (None, prose("d", 60)), (None, "d " + prose("d", 60)),
        (4, prose("e", 50)), (4, prose("e", 50)), (5, prose("f", 50)), (6, prose("g", 50)), (6, prose("f", 50) + " x"), (None, None), (12, " "), (13, prose("h", 3)), (None, prose("h", 3)),
    ]


def row_classes(rows):
    """The class of every row: rows of one id and rows of near texts are together."""
    cache = WordHashes()
    sets = [near_dedup.shingles((t or "").encode(), cache) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            near = near_dedup.probability_jaccard(sets[x], sets[y]) >= 0.8 or not len(sets[x][0]) and not len(sets[y][0])
            if near or rows[x][0] is not None and rows[x][0] == rows[y][0]:
                label = [label[y] if k == label[x] else k for k in label]
    return label


def test_repeated_and_missing_ids_lose_no_link(spark):
    rows = mixed_rows()
    label = row_classes(rows)
    smallest = {k: min((i for (i, _), n in zip(rows, label, strict=True) if n == k and i is not None), default=None) for k in label}
    schema = "doc_id long, text string, text_hash string, some_id int, row_number long, node long, words_key string"
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], schema)
    found = [tuple(r) for r in near_dedup.classes(df).select("doc_id", "class_id").collect()]
    named = {(i, smallest[k]) for (i, _), k in zip(rows, label, strict=True) if i is not None}
    unnamed = {((t or ""), smallest[k]) for (i, t), k in zip(rows, label, strict=True) if i is None}
    assert Counter(found) == Counter(named) + Counter((None, k) for _, k in unnamed)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    stay = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(stay) == len(set(label)) and Counter(i for i, _ in stay) == Counter(smallest.values())
    assert len({label[rows.index(r)] for r in stay}) == len(stay)


def test_pipeline_dedup_stages_equal_a_plain_chain(spark, sf_dir):
    import corpus_pipeline

    rows = [(i, f"{t}\nthe same last line in all") for i, t in near_rows() if i is not None] + [r for r in LINES if r[0] == 9]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = dict(corpus_pipeline.STAGES[1:3])
    for stage in out.values():
        docs = stage(spark, docs, sf_dir)
    left = {i: t for i, t, _, _ in kept_lines(rows)}
    stay = set(brute_classes(list(left.items())).values())
    assert sorted(docs.collect()) == sorted((i, t, len(t)) for i, t in left.items() if i in stay)
    assert len(stay) < len(rows)


def test_probability_jaccard_is_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sets = [(np.sort(rng.choice(40, 20, replace=False).astype(np.uint64)), rng.integers(1, 5, 20).astype(float)) for _ in range(2)]
        x, y = (dict(zip(s.tolist(), w.tolist(), strict=True)) for s, w in sets)
        keys = set(x) | set(y)
        expected = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys) for d in set(x) & set(y))
        assert near_dedup.probability_jaccard(*sets) == pytest.approx(expected)


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(5)
    both = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a = (both[:250], 1 + np.log2(rng.integers(1, 6, 250)))
    b = (both[50:], np.append(a[1][50:], 1 + np.log2(rng.integers(1, 6, 50))))
    a, b = [(s[np.argsort(s)], w[np.argsort(s)]) for s, w in (a, b)]
    rows = near_dedup.signatures([a, b], 4000)
    assert (rows[0] == rows[1]).mean() == pytest.approx(near_dedup.probability_jaccard(a, b), abs=0.04)
    alone = near_dedup.signatures([b], 4000)
    assert (alone[0] == rows[1]).all()


def test_blocks_of_a_bucket_find_what_joins_its_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = near_rows()
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows)).collect()} == brute_classes(rows) | {None: 403}


EDITS = [(1, "abc"), (2, "para one\npara two\npara three"), (3, None), (5, "ü😀" * 50), (8, prose(8, 300)), (9, prose(9, 40)), (13, ""), (-4, prose(8, 300))]


def test_edits_and_likeness(spark):
    out = {r["doc_id"]: r for r in fingerprints.compare_with_edits(frame(spark, EDITS)).collect()}
    order = sorted(EDITS, reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        row = out[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (text == edited)
    assert out[8]["fingerprint"] == out[-4]["fingerprint"] and out[3]["fingerprint"] == out[13]["fingerprint"]
    assert out[8]["near_edited"] > 0.45 and out[8]["near_next"] < 0.35
    assert fingerprints.compare_with_edits(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[(7, "alone in the table")], [(7, "a b c"), (7, "a b c"), (7, "x y z"), (None, "none"), (None, None)]])
def test_edits_of_few_and_repeated_rows(spark, rows):
    out = fingerprints.compare_with_edits(frame(spark, rows)).collect()
    assert Counter(r["n_chars"] for r in out) == Counter(len(t or "") for _, t in rows)


def test_many_ranges_give_the_same_neighbours(spark):
    rows = [(i * 3, prose(i, 12)) for i in range(60)]
    for ranges in (1, 7, 64):
        found = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(frame(spark, rows), ranges).collect()}
        assert found == {i: rows[k - 1][1] for k, (i, _) in enumerate(rows)}


def test_fingerprints_add_and_subtract(spark):
    df = spark.createDataFrame([("one two three\nfour five", "six seven\none two three", "four five\nsix seven\none two three\none two three")], "a string, b string, both string")
    a, b, both = (fingerprints.vector(F.col(c)) for c in df.columns)
    row = df.select((fingerprints.add(a, b) == both).alias("added"), (fingerprints.subtract(both, b) == a).alias("taken"), (a == b).alias("equal")).first()
    assert row["added"] and row["taken"] and not row["equal"]
