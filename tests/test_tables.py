import difflib
import json
import random
from datetime import date, datetime

import pytest
from conftest import rows

from sigvane import constants as K
from sigvane import runtime, schemas
from sigvane.functions import calendar as cal
from sigvane.functions import text as tx
from sigvane.operators import facts, hiring, identity, normalize, quality, summaries, universe
from sigvane.sources import readers, sinks
from sigvane.streaming.landing import land_new_files
from pyspark.sql import functions as F

SCORES = dict.fromkeys(K.SCORE_COLUMNS, "3")


def frame(spark, records):
    columns = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in records], ", ".join(f"`{c}` string" for c in columns))


# --- prices ---------------------------------------------------------------------------------------


def test_prices(spark):
    raw = frame(spark, [
        {"ticker": " msft ", "date": "2025-01-02", "adjusted_close": "100"},
        {"ticker": "msft", "date": "2025-01-03", "adjusted_close": "105"},
        {"ticker": "aapl", "date": "2025-01-02", "adjusted_close": "50"},
    ])
    got = rows(normalize.normalize_prices(raw).strict(), "ticker", "price_date")
    assert [r["ticker"] for r in got] == ["AAPL", "MSFT", "MSFT"]
    assert got[2]["daily_return"] == pytest.approx(0.05) and got[1]["daily_return"] is None
    assert got[0]["price_quarter"] == "2025Q1" and got[0]["available_at"] == datetime(2025, 1, 2)


def test_price_errors(spark):
    bad = frame(spark, [{"ticker": "A", "price_date": "2025-01-02", "adjusted_close": "-1"}] * 2 + [{"ticker": "A", "price_date": "x", "adjusted_close": "y"}])
    checked = normalize.normalize_prices(bad)
    assert {r["check"] for r in rows(checked.violations)} == {"adjusted_close_not_positive", "duplicate_price_record", "price_date_unparsable", "adjusted_close_not_numeric"}
    with pytest.raises(ValueError, match="adjusted_close_not_positive"):
        checked.strict()
    with pytest.raises(ValueError, match="lacks the columns"):
        normalize.normalize_prices(frame(spark, [{"ticker": "A"}]))
    with pytest.raises(ValueError, match="none of the columns"):
        normalize.normalize_prices(frame(spark, [{"price_date": "2025-01-02", "adjusted_close": "1"}]))


def test_missing_price_is_padded(spark):
    prices = spark.createDataFrame(
        [("C", None, date(2025, 1, d), v, "s") for d, v in ((1, 10.0), (2, None), (3, 11.0))],
        "company_id string, ticker string, price_date date, adjusted_close double, source_name string",
    )
    assert [r["daily_return"] for r in rows(normalize.add_daily_return(prices), "price_date")] == [None, 0.0, pytest.approx(0.1)]


# --- financials -----------------------------------------------------------------------------------


def financial(**changes):
    base = {"ticker": "abc", "fiscal_quarter": "2025q1", "fiscal_period_end": "2025-03-31", "available_at": "2025-04-25", "revenue": "1000.0", "gross_margin": "62.0", "operating_margin": "0.25"}
    return base | changes


def test_financials(spark):
    got = rows(normalize.normalize_financials(frame(spark, [financial()])).strict())[0]
    assert (got["gross_margin"], got["operating_margin"], got["fiscal_quarter"], got["revenue"]) == (0.62, 0.25, "2025Q1", 1000.0)


@pytest.mark.parametrize(
    ("change", "check"),
    [
        ({"available_at": "2025-03-01"}, "available_before_period_end"),
        ({"employee_count": "0"}, "employee_count_not_positive"),
        ({"gross_margin": "-0.1"}, "gross_margin_out_of_range"),
        ({"gross_margin": "150"}, "gross_margin_out_of_range"),
        ({"revenue": "abc"}, "revenue_not_numeric"),
    ],
)
def test_financial_errors(spark, change, check):
    with pytest.raises(ValueError, match=check):
        normalize.normalize_financials(frame(spark, [financial(**change)])).strict()


def test_early_availability_can_be_a_warning(spark):
    checked = normalize.normalize_financials(frame(spark, [financial(available_at="2025-03-01")]), allow_early=True)
    assert not checked.strict().isEmpty()
    assert rows(checked.violations)[0]["severity"] == "warning"


# --- scores ---------------------------------------------------------------------------------------


def score(**changes):
    return {"ticker": " aaa ", "snapshot_date": "2025-03-31", "source_name": "x", "available_at": "2025-04-02"} | SCORES | changes


def test_scores(spark):
    got = rows(normalize.normalize_scores(frame(spark, [score(unused_raw_field="keep")])).strict())[0]
    assert json.loads(got["metadata_json"]) == {"unused_raw_field": "keep"}
    assert (got["ticker"], got["score_quarter"], got["available_at_assumption"]) == ("AAA", "2025Q1", False)
    plain = {k: v for k, v in score().items() if k != "available_at"}
    assumed = rows(normalize.normalize_scores(frame(spark, [plain]), "2025-05-01").strict())[0]
    assert assumed["available_at_assumption"] and assumed["metadata_json"] == "{}"
    with pytest.raises(ValueError, match="available_at"):
        normalize.normalize_scores(frame(spark, [plain]))


@pytest.mark.parametrize(("value", "check"), [("6", "out_of_range"), ("3.5", "not_whole"), ("x", "not_numeric")])
def test_score_errors(spark, value, check):
    with pytest.raises(ValueError, match=check):
        normalize.normalize_scores(frame(spark, [score(**{K.SCORE_COLUMNS[0]: value})])).strict()


# --- postings -------------------------------------------------------------------------------------


def test_postings(spark):
    raw = frame(spark, [
        {"job_posting_id": "1", "ticker": "AAA", "title": "Prompt  Engineer", "description": "x", "collected_at": "2025-01-02", "source_name": "s", "is_active": "yes"},
        {"job_posting_id": "2", "ticker": "AAA", "title": "prompt engineer", "description": "X", "collected_at": "2025-01-03", "source_name": "s", "is_active": "0"},
        {"job_posting_id": "3", "ticker": "BBB", "title": "Store Manager", "description": "uses allms", "collected_at": "2025-01-03", "source_name": "s"},
    ])
    got = rows(normalize.normalize_postings(raw).strict(), "job_posting_id")
    assert [r["is_likely_duplicate"] for r in got] == [False, True, False]
    assert [r["is_ai_keyword_matched"] for r in got] == [True, True, False]
    assert [r["is_active"] for r in got] == [True, False, None]
    assert len(got[0]["raw_hash"]) == 64 and got[0]["raw_hash"] == got[1]["raw_hash"]
    assert rows(summaries.summarize_postings(normalize.normalize_postings(raw).rows))[0]["likely_duplicate_count"] == 1


def test_posting_without_identifier(spark):
    raw = frame(spark, [{"job_posting_id": "1", "ticker": " ", "title": "t", "collected_at": "2025-01-02", "source_name": "s"}])
    with pytest.raises(ValueError, match="identifier_missing"):
        normalize.normalize_postings(raw).strict()


def test_sampling(spark):
    postings = spark.createDataFrame(
        [("1", True, "a", ""), ("2", True, "b", ""), ("3", False, "Software Engineer", ""), ("4", False, "Cook", ""), ("5", False, "VP of Software", "")],
        "id string, is_ai_keyword_matched boolean, title string, description string",
    )
    bucket = tx.sampling_bucket(F.col("is_ai_keyword_matched"), F.col("title"), F.col("description"))
    full = postings.withColumn("sampling_bucket", bucket)
    assert [r["sampling_bucket"] for r in rows(full, "id")] == ["ai_keyword_matched"] * 2 + ["technical_non_ai", "non_technical", "leadership_strategy"]
    once, again = (rows(hiring.stratified_sample(full, "id", per_bucket=1, seed=3), "id") for _ in range(2))
    assert [r["id"] for r in once] == [r["id"] for r in again] and len(once) == 4
    assert next(r for r in once if r["sampling_bucket"] == "ai_keyword_matched")["sample_weight"] == 2.0
    share = rows(hiring.weighted_share(hiring.stratified_sample(full, "id", per_bucket=1)))[0]["weighted_share"]
    assert share == pytest.approx(2 / 5)
    with pytest.raises(ValueError, match="less than zero"):
        hiring.stratified_sample(full, "id", per_bucket=-1)


# --- identity -------------------------------------------------------------------------------------


def master(spark):
    return normalize.normalize_companies(frame(spark, [
        {"company_id": "C1", "name": "Aiva", "ticker": " aiva ", "cik": "1001.0", "sector": "Tech", "extra": "e"},
        {"company_id": "C2", "name": "Brio", "ticker": "brio", "cik": "0000001002", "sector": "nan"},
    ])).strict()


def test_master(spark):
    got = rows(master(spark), "ticker")
    assert [(r["ticker"], r["cik"], r["sector"], r["extra"]) for r in got] == [("AIVA", "0000001001", "Tech", "e"), ("BRIO", "0000001002", None, None)]


@pytest.mark.parametrize(
    ("second", "check"),
    [
        ({"company_id": "C1", "ticker": "B"}, "duplicate_company_id"),
        ({"company_id": "C2", "ticker": " a"}, "duplicate_ticker"),
        ({"company_id": "C2", "ticker": "B", "cik": "7"}, "duplicate_cik"),
        ({"company_id": "C2", "ticker": "B", "cik": "7x"}, "cik_not_digits"),
        ({"company_id": "C2", "ticker": ""}, "ticker_missing"),
    ],
)
def test_master_errors(spark, second, check):
    raw = frame(spark, [{"company_id": "C1", "name": "N", "ticker": "A", "cik": "0000000007"}, {"name": "M"} | second])
    with pytest.raises(ValueError, match=check):
        normalize.normalize_companies(raw).strict()


def test_join_guards(spark):
    twice = frame(spark, [{"company_id": "C1", "v": "1"}, {"company_id": " C1 ", "v": "2"}])
    with pytest.raises(ValueError, match="repeats on both sides"):
        identity.join_on_company_id(twice, twice)
    joined = rows(identity.join_on_company_id(twice, master(spark)), "v")
    assert [r["ticker"] for r in joined] == ["AIVA", "AIVA"]
    right = identity.join_on_company_id(twice, master(spark), how="right")
    assert right.count() == 3


def test_attach_company_id(spark):
    by_ticker = frame(spark, [{"company_id": "C1", "ticker": "aiva"}, {"company_id": None, "ticker": " brio"}])
    assert [r["company_id"] for r in rows(identity.attach_company_id(by_ticker, master(spark)), "ticker")] == ["C1", "C2"]
    complete = frame(spark, [{"company_id": "C2", "v": "1"}])
    assert rows(identity.attach_company_id(complete, master(spark)))[0]["company_id"] == "C2"
    for record, check in (({"company_id": "C1", "ticker": "BRIO"}, "conflicting"), ({"company_id": "C9", "ticker": "AIVA"}, "unknown"), ({"company_id": None, "ticker": "MISS"}, "unmapped")):
        with pytest.raises(ValueError, match=check):
            identity.attach_company_id(frame(spark, [record]), master(spark))


def test_unmatched_report(spark):
    data = frame(spark, [{"ticker": "MISS"}, {"ticker": "aiva"}, {"ticker": None}])
    assert rows(identity.unmatched_rows(master(spark), {"prices": data})) == [{"dataset": "prices", "ticker": "MISS", "unmatched_rows": 1}]


def brute_force_match(words, names, cutoff):
    import difflib

    return {w: m[0] for w in words if (m := difflib.get_close_matches(w, names, n=1, cutoff=cutoff))}


def test_a_common_word_in_names_costs_no_pairs(spark):
    """Names that begin alike are found by their other letters, and every partner of brute force is."""
    rng = random.Random(12)
    names = sorted({"holding" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=13)) for _ in range(500)})
    words = []
    for name in rng.sample(names, 60):
        at, letter = rng.randrange(len(name)), rng.choice("qxz")
        words += [name, name[:at] + letter + name[at + 1 :], name[:at] + name[at + 1 :], name[:at] + letter + name[at:]]
    words = sorted(set(words))
    left, right = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names], "name string")
    near = {(w, n) for w in words for n in names if difflib.SequenceMatcher(None, n, w).ratio() >= 0.92}
    proposed = {tuple(r) for r in identity.fuzzy_pairs(left, right).collect()}
    assert near <= proposed and len(near) >= 60
    assert len(proposed) < 20 * len(words)  # a piece of the common word alone would propose all 500 for every word
    assert near <= {tuple(r) for r in identity.fuzzy_candidates(left, right).collect()}
    commonest = identity.name_pieces(right).groupBy("n", "k", "i", "piece").count().agg(F.max("count")).first()[0]
    assert commonest < 60


def test_names_without_a_common_piece_are_cut_one_way(spark):
    """A few chance copies of a piece do not make every word probe for other cuts."""
    rng = random.Random(5)
    names = spark.createDataFrame([(f"{rng.getrandbits(128):032x}",) for _ in range(3000)], "name string")
    assert [r["k"] for r in identity.name_pieces(names).select("k").distinct().collect()] == [6]


def test_moved_pieces_find_every_partner_at_low_cutoffs(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)})
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)})
    left, right = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names], "name string")
    for cutoff in (0.75, 0.55):
        near = {(w, n) for w in words for n in names if difflib.SequenceMatcher(None, n, w).ratio() >= cutoff}
        assert near <= {tuple(r) for r in identity.fuzzy_candidates(left, right, cutoff).collect()}


def test_fuzzy_match_finds_what_brute_force_finds(spark):
    import random

    random.seed(9)
    names = sorted({"".join(random.choice("abcde ") for _ in range(random.randint(4, 30))).strip() for _ in range(150)})
    words = set()
    for name in names:
        text = list(name)
        for _ in range(random.randint(0, 3)):
            place = random.randrange(len(text))
            random.choice([lambda: text.insert(place, "z"), lambda: text.pop(place) if len(text) > 3 else None, lambda: text.__setitem__(place, "q")])()
            place = 0
        words.add("".join(text))
    for cutoff in (0.92, 0.85):
        expected = brute_force_match(sorted(words), names, cutoff)
        found = identity.fuzzy_match(
            spark.createDataFrame([(w,) for w in sorted(words)], "word string"), spark.createDataFrame([(n,) for n in names], "name string"), cutoff
        )
        assert {r["word"]: r["name"] for r in rows(found)} == expected


def test_resolution_order(spark):
    entities = spark.createDataFrame(
        [("1", "Acme, Inc.", "s"), ("2", "Privato", "s"), ("3", "Nickname", "s"), ("4", "Beta & Sons Corp", "s"), ("5", "Gamma Interational Logistics", "s"), ("6", "Nowhere", "s")],
        "company_id string, name string, sector string",
    )
    members = spark.createDataFrame(
        [("Acme Corp", "ACM", "0000000001", "Tech", 1), ("Delta", "DLT", "0000000002", "Tech", 2), ("Gamma International Logistics", "GIL", "0000000003", "Ind", 3)],
        "member_name string, ticker string, cik string, gics_sector string, ord int",
    )
    registry = spark.createDataFrame([("BETA AND SONS", "BET", "0000000009", 1), ("BETA AND SONS", "BETX", "0000000009", 2)], "title string, ticker string, cik string, ord int")
    got = {r["company_id"]: r for r in rows(identity.resolve_entities(entities, members, registry, {"Privato": "private"}, {"Nickname": "DLT"}))}
    assert {k: (r["ticker"], r["match_method"]) for k, r in got.items()} == {
        "1": ("ACM", "member_exact"), "2": (None, "private:private"), "3": ("DLT", "manual"), "4": ("BET", "registry_exact"),
        "5": ("GIL", "member_fuzzy:gamma international logistics"), "6": (None, "unmatched"),
    }
    assert got["3"]["in_members"] and got["3"]["cik"] == "0000000002"


def test_resolution_of_part_names_covers_every_part(spark):
    """The real part names, many of them alike, against brute force; the queries' own names are held by their SQL."""
    from sigvane.plans import queries_entities as Q

    sf_dir = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand").collect()
    lists = ({}, {})  # even keys are members, odd ones the registry; the first key of a name counts
    for key, name, brand in sorted(parts):
        lists[key % 2].setdefault(f"{name} {brand}".lower(), f"{'PR'[key % 2]}{key}")

    def expected(key, name, manual=()):
        shown = f"Unlisted {name}" if key % 12 == 9 else name[:4] + name[3:] if key % 12 == 3 else name
        if shown in manual:
            return manual[shown]
        word = " ".join(shown.lower().split())
        for label, names in zip(("member", "registry"), lists, strict=True):
            if word in names:
                return names[word], f"{label}_exact"
        for label, names in zip(("member", "registry"), lists, strict=True):
            found = brute_force_match([word], list(names), K.FUZZY_CUTOFF).get(word)
            if found:
                return names[found], f"{label}_fuzzy:{found}"
        return None, "unmatched"

    listed = {"Unlisted small ring Brand#2": (None, "private:private"), "Unlisted red bolt Brand#1": ("P2", "manual")}
    inputs = Q._covered(spark, sf_dir), Q._members(spark, sf_dir), Q._registry(spark, sf_dir)
    resolved = identity.resolve_entities(*inputs, {"Unlisted small ring Brand#2": "private"}, {"Unlisted red bolt Brand#1": "P2"})
    full = identity.flag_universe_duplicates(identity.add_uncovered_members(resolved, inputs[1])).collect()
    covered = [r for r in full if r["in_coverage"]]
    assert len(covered) == len(parts)
    assert {r["company_id"]: (r["ticker"], r["match_method"]) for r in covered} == {str(k): expected(k, f"{n} {b}", listed) for k, n, b in parts}
    taken = {r["ticker"] for r in covered}
    assert sorted(r["ticker"] for r in full if not r["in_coverage"]) == sorted(f"P{k}" for k, _, _ in parts if k % 2 == 0 and f"P{k}" not in taken)

    methods = [(expected(k, f"{n} {b}")) for k, n, b in parts]
    counts = {r["match_method"]: r["entities"] for r in identity.match_method_counts(identity.resolve_entities(*inputs, {}, {})).collect()}
    assert counts == {m: sum(x[1].split(":")[0] == m for x in methods) for m in {x[1].split(":")[0] for x in methods}}


def test_identifier_spans_join_by_cells(spark):
    days = [date(1, 1, 1), date(1969, 12, 31), date(1995, 1, 1), date(1995, 7, 20), date(2001, 8, 1), date(2400, 2, 29), date(9999, 12, 30), date(9999, 12, 31), None]
    ends = [date(1969, 12, 31), date(1995, 1, 1), date(1995, 1, 2), date(1996, 3, 4), date(2020, 1, 1), date(9999, 12, 31), None]
    history = [(i, f"{i}{a}{b}", a, b) for i in "AB" for a in ends for b in ends] + [("D", "d", None, None), (None, "n", None, None)]
    facts = [(n, i, d) for n, (i, d) in enumerate((i, d) for i in ("A", "B", "C", "D", None) for d in days)]
    facts += [(100 + n, "A", date.fromordinal(date(1994, 12, 1).toordinal() + n)) for n in range(500)]
    expected = []
    for n, i, d in facts:
        holders = [c for j, c, a, b in history if i is not None and i == j and d is not None and (a or date(1, 1, 1)) <= d < (b or date(9999, 12, 31))]
        expected += [(n, c) for c in holders or [None]]
    spans = spark.createDataFrame(history, "identifier string, company_id string, valid_from date, valid_to date")
    got = readers.valid_identifiers(spark.createDataFrame(facts, "n long, identifier string, day date"), spans, "day")
    assert got.columns == ["n", "identifier", "day", "held_by"]
    assert sorted(((r["n"], r["held_by"]) for r in got.collect()), key=str) == sorted(expected, key=str)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("<" in line for line in joins)  # no range test on pairs of one identifier


def test_duplicate_flags(spark):
    u = spark.createDataFrame(
        [(None, "Z", "T1", "1", False), ("a", "A", "T2", "1", True), ("b", "B", "T3", "1", True), ("c", "C", "T3", None, True), (None, "D", None, None, True)],
        "company_id string, name string, ticker string, cik string, in_coverage boolean",
    )
    got = rows(identity.flag_universe_duplicates(u), "name")
    assert [(r["name"], r["ticker_dup"], r["share_class_dup"]) for r in got] == [("A", False, False), ("B", True, True), ("C", True, False), ("D", False, False), ("Z", False, True)]


def test_entity_dedup(spark):
    entities = spark.createDataFrame(
        [("a", "Acme ", "2024-01-01", 1), ("b", " Acme", "2024-02-01", 2), ("c", "Test Company", "2024-01-01", 3), ("d", "Solo", None, 4)],
        "company_id string, name string, created_at string, ord int",
    )
    pages = spark.createDataFrame([("a", 2, "2024-05-01", '{"aiScores": {"maturityIndex": "3"}}'), ("b", 9, "2024-09-01", "{}")], "company_id string, version int, created_at string, j string")
    pages = pages.select("company_id", "version", "created_at", F.from_json("j", universe.CONTENT_SCHEMA).alias("content"))
    kept, log = universe.dedupe_entities(entities, pages)
    assert [r["company_id"] for r in rows(kept, "company_id")] == ["a", "d"]
    assert {(r["action"], r["id"], r["kept_id"]) for r in rows(log)} == {("drop_duplicate_name", "b", "a"), ("drop_test_row", "c", None)}


# --- facts ----------------------------------------------------------------------------------------


def fact(start, end, val, filed):
    return {"start": start, "end": end, "val": val, "filed": filed}


def test_facts(spark):
    revenue = [
        fact("2025-10-01", "2025-12-31", 100.0, "2026-02-01"), fact("2025-10-01", "2025-12-31", 999.0, "2026-05-01"),
        fact("2025-01-01", "2025-12-31", 380.0, "2026-02-01"), fact("2026-01-01", "2026-03-31", 120.0, "2026-05-01"),
        fact("2025-01-01", "2025-03-31", 80.0, "2025-05-01"), fact("2024-10-01", "2024-12-31", 50.0, "2025-02-01"),
    ]
    income = [fact("2026-01-01", "2026-03-31", 30.0, "2026-05-01"), fact("2025-01-01", "2025-03-31", 8.0, "2025-05-01")]
    nested = {
        "us-gaap": {"Revenues": {"units": {"USD": revenue}}, K.REVENUE_CONCEPTS[0]: {"units": {"USD": revenue[:1]}}, K.OPERATING_INCOME: {"units": {"USD": income}}},
        "dei": {K.EMPLOYEE_CONCEPT: {"units": {"pure": [fact(None, "2024-12-31", 7.0, None), fact(None, "2025-12-31", 9.0, None)]}}, K.SHARES_CONCEPT: {"units": {"shares": [fact(None, "2026-02-01", 10.0, None), fact(None, "2026-04-01", 99.0, None)]}}},
    }
    df = spark.createDataFrame([("A", "0000000001", nested)], schemas.FACTS)
    got = rows(facts.quarter_outcomes(df, "2026-01-19"))[0]
    assert got["q_end"] == date(2026, 3, 31) and got["rev_prev"] == 100.0
    assert got["rev_growth_yoy"] == pytest.approx(0.5) and got["rev_growth_qoq"] == pytest.approx(0.2)
    assert got["op_margin_q"] == pytest.approx(0.25) and got["op_margin_delta_yoy"] == pytest.approx(0.15) and got["op_margin_delta_qoq"] is None
    assert (got["employees"], got["employees_asof"]) == (9.0, "2025-12-31")
    assert rows(facts.prior_growth(df, "2026-01-19"))[0]["prior_rev_growth_yoy"] == pytest.approx(1.0)
    prices = spark.createDataFrame([("A", date(2026, 1, 20), 3.0)], "ticker string, price_date date, adjusted_close double")
    cap = facts.market_caps(df, prices, spark.createDataFrame([("A", 5.0)], "ticker string, market_cap double"), "2026-01-19")
    assert rows(cap)[0] == {"ticker": "A", "mktcap_t0": 30.0, "mktcap_source": "sec_shares_x_jan_price"}
    spare = facts.market_caps(df, prices.where("false"), spark.createDataFrame([("A", 5.0)], "ticker string, market_cap double"), "2026-01-19")
    assert rows(spare)[0]["mktcap_source"] == "fallback_current"


# --- hiring ---------------------------------------------------------------------------------------


def test_hiring_rates(spark):
    def posts(name, matched):
        return [(name, "s", i < matched, "ai-builder" if i == 0 else "non-ai") for i in range(max(matched, 1))]

    df = spark.createDataFrame([*posts("zero", 0), *posts("four", 4), *posts("five", 5)], "ticker string, snapshot string, is_company_match boolean, ai_role_type string")
    got = {r["ticker"]: r["builder_rate"] for r in rows(hiring.hiring_signal(df))}
    assert got == {"zero": None, "four": 0.25, "five": 0.2}
    thin = {r["ticker"]: r["builder_rate"] for r in rows(hiring.null_thin_rates(hiring.hiring_signal(df)))}
    assert thin == {"zero": None, "four": None, "five": 0.2}
    unknown = spark.createDataFrame([(None, 0.5)], "n_matched int, builder_rate double")
    assert rows(hiring.null_thin_rates(unknown))[0]["builder_rate"] == 0.5


def test_request_batches_and_replies(spark):
    results = spark.createDataFrame([("E", i, f"t{i}") for i in range(27)], "e string, ord int, t string")
    body = F.concat(F.lit("["), F.col("result_index").cast("string"), F.lit("] "), F.col("t"))
    got = rows(hiring.request_batches(results, "e", "ord", F.lit("HEAD"), body, 25), "batch")
    assert [r["results"] for r in got] == [25, 2]
    assert got[1]["request"] == "HEAD\n\nRESULTS:\n[0] t25\n[1] t26"
    reply = '```json\n[{"result_index": 0, "is_company_match": true, "ai_role_type": "odd"}, {"result_index": 9, "ai_role_type": "ai-user"}]\n```'
    replies = spark.createDataFrame([("E", reply)], "e string, reply string")
    parsed = rows(hiring.parse_replies(replies, spark.createDataFrame([("E", 0), ("E", 1)], "e string, result_index int"), ["e"]))
    assert [(r["result_index"], r["is_company_match"], r["ai_role_type"]) for r in parsed] == [(0, True, "non-ai")]


def test_failed_replies_withhold_their_entity(spark):
    good = '[{"result_index": 0, "ai_role_type": "ai-user"}]'
    replies = spark.createDataFrame([("A", 0, good), ("A", 1, good[:-9]), ("B", 0, good), ("C", 0, None), ("D", 0, good)], "e string, batch int, reply string")
    results = spark.createDataFrame([("A", 0, 0), ("A", 1, 0), ("B", 0, 0), ("C", 0, 0), ("D", 0, 0), ("D", 1, 0)], "e string, batch int, result_index int")
    failed = rows(hiring.failed_replies(replies, ["e", "batch"]), "e")
    assert [(r["e"], r["batch"], r["error"], r["reply"]) for r in failed] == [("A", 1, "invalid_json", good[:-9]), ("C", 0, "no_reply", None)]
    assert [r["e"] for r in rows(hiring.parse_replies(replies, results, ["e", "batch"], entity=["e"]))] == ["B"]
    assert sorted(r["e"] for r in rows(hiring.parse_replies(replies, results, ["e", "batch"]))) == ["A", "B", "D"]


# --- functions, schemas, sources ------------------------------------------------------------------


def test_text_functions(spark):
    df = spark.createDataFrame([("The Acme Holdings, Inc. & Co", " 2024Q4 ")], "n string, q string")
    got = rows(df.select(tx.name_key(F.col("n")).alias("k"), cal.shift_quarter(F.trim("q"), 2).alias("q"), tx.normalize_source_type(F.lit("SEC Filing ")).alias("s")))[0]
    assert got == {"k": "acme and", "q": "2025Q2", "s": "sec_filing"}
    words = spark.createDataFrame([("TRUE",), ("n",), ("maybe",), (None,)], "b string")
    assert [r["b"] for r in rows(words.select(tx.parse_bool(F.col("b")).alias("b")))] == [True, False, True, None]


def test_feature_tables_say_when_they_were_known():
    for observed, ddl in schemas.FEATURE_TABLES.values():
        names = [c.split()[0] for c in ddl.split(", ")]
        assert observed in names and "available_at" in names


def test_tables_by_suffix(spark):
    path = runtime.scratch_path(spark, "t.csv")
    sinks.write_table(frame(spark, [{"cik": "0000000007", "text": 'a "b"\nc'}]), path)
    assert rows(readers.read_table(spark, path, multi_line=True)) == [{"cik": "0000000007", "text": 'a "b"\nc'}]
    with pytest.raises(ValueError, match="must end with"):
        readers.read_table(spark, "x.json")
    with pytest.raises(ValueError, match="must end with"):
        sinks.write_table(spark.range(1), "x.json")
    missing = []
    assert readers.read_optional(spark, runtime.scratch_path(spark, "no.parquet"), "a int", "panel", missing).isEmpty()
    assert missing == ["panel"]


def test_snapshots_keep_each_other(spark):
    path = runtime.scratch_path(spark, "snap")
    for name, n in (("2025-01", 1), ("2025-02", 2), ("2025-01", 3)):
        sinks.write_snapshot(spark.range(n), path, name)
    back = spark.read.parquet(path)
    assert back.count() == 5
    newest = readers.latest_snapshot(back.withColumn("snapshot", F.col("snapshot").cast("string")))
    assert newest.count() == 2


def test_documents_jsonl(spark):
    good = {"source_document_id": "d1", "source_type": "News", "source_date": "2024-01-01", "text": "hello", "ticker": "A"}
    lines = [json.dumps(good), "", "{broken", json.dumps(good | {"source_type": "rumour"}), json.dumps(good | {"text": " "})]
    path = runtime.scratch_path(spark, "docs")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    docs, bad = readers.read_documents(spark, path)
    assert [r["source_document_id"] for r in rows(docs)] == ["d1"]
    long = runtime.scratch_path(spark, "long")
    spark.createDataFrame([(json.dumps(good | {"text": "x" * n}),) for n in (12_000, 50_000)], "value string").write.text(long)
    kept = rows(readers.read_documents(spark, long)[0])
    assert sorted((len(r["text"]), r["warnings"]) for r in kept) == [(12_000, []), (50_000, ["long_text"])]
    assert [(r["line_number"], r["errors"]) for r in rows(bad, "line_number")] == [(3, ["invalid_json"]), (4, ["source_type"]), (5, ["text_length"])]


def test_search_results_per_key_files(spark):
    path = runtime.scratch_path(spark, "raw")
    record = {"ticker": "A", "company": "Acme", "snapshot": "2025-01", "results": [{"title": "x", "url": "u", "published_date": "2025", "highlights": ["h"]}] * 2}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(path)
    files = readers.read_json_files(spark, path, schemas.SEARCH_RESULTS, "part-*")
    assert files.selectExpr("size(results) AS n").first()["n"] == 2
    assert readers.read_json_snapshot(spark, path, schemas.SEARCH_RESULTS).count() == 1


def test_landing_takes_new_files_once(spark):
    root = runtime.scratch_path(spark, "landing")
    for i in range(2):
        spark.range(i * 10, i * 10 + 3).write.mode("append").json(f"{root}/in")
        for _ in range(2):
            land_new_files(spark, f"{root}/in", "id long", f"{root}/out", f"{root}/progress")
    assert sorted(r["id"] for r in rows(spark.read.schema("id long").parquet(f"{root}/out"))) == [0, 1, 2, 10, 11, 12]


def test_quality_helpers(spark):
    df = frame(spark, [{"a": "1", "b": None}, {"a": "1", "b": None}, {"a": None, "b": "x"}, {"a": None, "b": "y"}])
    assert rows(quality.duplicate_keys(df, ["a", "b"]))[0]["n"] == 2
    assert {r["a"] for r in rows(quality.duplicate_keys(df, ["a"]))} == {"1", None}
    assert {r["a"] for r in rows(quality.duplicate_keys(df, ["a"], ignore_nulls=True))} == {"1"}
    assert [r["markers"] for r in rows(quality.secret_scan(frame(spark, [{"k": "1", "t": "API_KEY=1"}]), "t", "k", ["api_key", "token"]))] == [["api_key"]]
