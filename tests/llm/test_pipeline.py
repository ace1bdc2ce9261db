"""The classifier and the whole pipeline against plain Python, row by row."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_dedup import kept_lines, row_classes
from tokenizers import Tokenizer

import __spark_entry__ as entrypoint
import corpus_pipeline
from sigvane.llm import pii, quality_classifier

MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15
WORDS = [f"w{i}" for i in range(400)]


def hashed(numbers):
    """The hash of consecutive numbers."""
    out = numbers[0]
    for x in numbers[1:]:
        out = (out * MULTIPLIER + x) & MASK
        out ^= out >> 29
    return out


def plain_indicators(text, bits=quality_classifier.BITS):
    raw = (text or "").encode()
    words = [xxhash.xxh3_64_intdigest(w) for w in raw.split()]
    edge = xxhash.xxh3_64_intdigest(b"\n")
    padded = b" " + raw + b" "
    ngrams = set(words) | {hashed(pair) for pair in zip([edge, *words], [*words, edge], strict=True)}
    ngrams |= {(a << 16 | b << 8 | c) + (1 << 30) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)}
    found = {((n ^ n >> 31) * MULTIPLIER & MASK) >> (64 - bits) for n in ngrams}
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    if any(a == b for a, b in zip(words, words[1:], strict=False)):
        found.add(0)
    if any(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False)):
        found.add(1)
    if len(set(windows)) < len(windows):
        found.add(2)
    return np.array(sorted(found), np.uint32)


def plain_scores(rows, labels):
    """The score of every row (id, text), learned from the labels outside the held-out remainder."""
    said = {}
    for i, quality, _ in labels:
        if i is not None and quality in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            said.setdefault(i, []).append(quality)
    texts = {i: min(t or "" for j, t in rows if j == i) for i in said if any(j == i for j, _ in rows)}
    train = [plain_indicators(texts[i]) for i in sorted(texts)]
    marks = np.array([int(sum(said[i]) / len(said[i]) >= 0.5) for i in sorted(texts)], int)
    model = quality_classifier.fit_rows(train, marks)
    weights, ratios = model.weights.astype(np.float32), model.ratios.astype(np.float32)
    scores = []
    for _, text in rows:
        found = plain_indicators(text)
        norm = math.sqrt(sum(float(r) ** 2 for r in ratios[found])) or 1.0
        margin = sum(float(w) * float(r) for w, r in zip(weights[found], ratios[found], strict=True)) / norm + model.bias
        scores.append(1 / (1 + math.exp(-(model.slope * margin + model.offset))))
    return scores


def test_query_scores_every_document_as_plain_python_does(spark, sf_dir):
    folder = sf_dir.replace("sf0.01", "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    out = entrypoint.queries()["op1_quality_classifier"](spark, folder).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == [i for i, _ in rows]
    assert [r["score"] for r in out] == pytest.approx(plain_scores(rows, labels), abs=2e-4)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def corpus():
    rng = random.Random(8)
    good = [" ".join(rng.choices(WORDS, k=rng.randrange(40, 90))) for _ in range(40)]
    bad = [" ".join(rng.choices(["BUY!!", "$$$", "|", "now", "w1"], k=60)) for _ in range(16)]
    rows = [(i, f"{t}\na line that is the same in every good text") for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    labels = [(i, 1, 0) for i in range(36)] + [(100 + i, 0, 1) for i in range(14)] + [(7, None, 0), (None, 1, 0), (9999, 0, 1), (3, 1, 0)]
    rows += [(200 + i, good[i] + " one more") for i in range(6)]
    rows += [(3, good[3]), (4, good[4] + "\n" + good[4]), (300, good[30]), (300, good[31] + " changed"), rows[5], rows[5], rows[42]]
    rows += [(None, good[8] + " without an id"), (None, good[8] + " without an id"), (None, " ".join(rng.choices(WORDS, k=50))), (None, None), (None, "")]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "\n".join(" ".join(rng.choices(WORDS, k=30)) for _ in range(300)))]
    rows += [(500, good[20][::-1] + " card 4337166598464399 and tel +1 (826) 555-4081"), (501, " ".join(rng.choices(WORDS, k=40)) + " mail hoccrcif.96@mail8.example.com card 4337166598464399")]
    rng.shuffle(rows)
    return rows, labels


CLASHING = ["score", "line_dedup", "owner", "place", "words_key", "row_number", "text_hash", "n_replaced", "sequence_id", "class_id"]


def stored(spark, folder, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    data = [(i, t, None, "s", len(t or ""), *[f"{c} of {n}" for c in CLASHING]) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_every_stage_equals_plain_python(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows and clashing names go through all stages."""
    rows, labels = corpus()
    docs = stored(spark, tmp_path, rows, labels)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def through(name, docs):
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        stages[name](spark, docs, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    def pairs(df):
        assert df.columns == columns
        found = df.collect()
        by_row = {r["score"]: r for r in found}
        assert all(all(r[c].split(" of ")[1] == r["score"].split(" of ")[1] for c in CLASHING) for r in found) and len(by_row) == len(found)
        return [(r["doc_id"], r["text"]) for r in found], found

    scores = plain_scores(rows, labels)
    assert not [s for s in scores if abs(s - 0.3) < 1e-3]
    good = through("quality classifier", docs)
    left, _ = pairs(good)
    assert Counter(left) == Counter(r for r, s in zip(rows, scores, strict=True) if s >= 0.3)
    assert {100, 101} & {i for i, _ in rows} and not {100, 101} & {i for i, _ in left}

    lines = through("line dedup", good)
    unlined, found = pairs(lines)
    named = [r for r in left if r[0] is not None]
    assert Counter(r for r in unlined if r[0] is not None) == Counter((i, t) for (i, t, _, _), n in kept_lines(named).items() for _ in range(n))
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(unlined) == len(left)

    single = through("near dedup", lines)
    one, _ = pairs(single)
    label = row_classes(unlined)
    smallest = {k: min((i for (i, _), n in zip(unlined, label, strict=True) if n == k and i is not None), default=None) for k in set(label)}
    assert Counter(i for i, _ in one) == Counter(smallest.values()) and set(one) <= set(unlined)
    assert len({label[unlined.index(r)] for r in one}) == len(one)

    hidden = through("pseudonyms", single)
    masked, found = pairs(hidden)
    shown = pii.pseudonymize(hidden.select("doc_id", "text"), corpus_pipeline.PSEUDONYM_KEY, inverse=True)
    assert Counter((r["doc_id"], r["text"]) for r in shown.collect()) == Counter(one)
    changed = [t for t in masked if t not in one]
    assert {500, 501} <= {i for i, _ in changed} and not any("4337166598464399" in t for _, t in masked)
    cards = [t.split("card ")[1].split()[0] for _, t in changed if "card " in t]
    assert len(cards) == 2 and cards[0] == cards[1]

    pieces = stages["packing"](spark, hidden, str(tmp_path)).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t in masked:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            expected[(i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == expected
    ends = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_no_documents_give_no_pieces(spark, tmp_path):
    _, labels = corpus()
    stored(spark, tmp_path, [], labels)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "sequence_id", "offset"} <= set(out.columns)
