"""Run reports and copy verdicts, rule by rule, on small reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runledger.functions import columns as X
from runledger.operators import reconcile as R
from runledger.operators.reconcile import LAST_COPY, TOTAL_BYTES, TOTAL_FILES

GET = "Get File"


def copy(fr=1, fw=1, dr=5, dw=5):
    out = {"filesRead": fr, "filesWritten": fw, "dataRead": dr, "dataWritten": dw}
    return {"activityType": "Copy", "activityName": "C", "output": {k: v for k, v in out.items() if v is not None}}


def meta(name, size, activity=GET):
    return {"activityType": "GetMetadata", "activityName": activity, "output": {"itemName": name, "size": size}}


def report(*acts):
    return json.dumps({"id": "x", "value": list(acts)})


def parsed(spark, docs):
    return R.parse_reports(spark.createDataFrame(docs, "run_id long, doc string"))


def verdicts(spark, docs, data, control=(), rule=TOTAL_FILES, allowed=0):
    files = "run_id long, file_nm string, file_size long"
    facts = R.copy_facts(parsed(spark, docs), ["run_id"], GET, "activity_seq",
                         spark.createDataFrame(list(data), files), spark.createDataFrame(list(control), files))
    return {r.run_id: r.verdict for r in R.run_verdicts(facts, ["run_id"], rule, allowed).collect()}


# ------------------------------------------------------------------ X6
def test_activities_keep_their_order_and_fields(spark):
    doc = report({"activityType": "Wait"}, copy(3, 2, 9, 8), meta("f", 7), {"activityType": "Copy", "output": "failed"})
    rows = parsed(spark, [(1, doc)]).orderBy("activity_seq").collect()
    assert [(r.activity_seq, r.activity_type, r.files_read, r.files_written, r.data_read, r.data_written, r.item_name,
             r.item_size, r.is_malformed) for r in rows] == [
        (0, "Wait", None, None, None, None, None, None, False), (1, "Copy", 3, 2, 9, 8, None, None, False),
        (2, "GetMetadata", None, None, None, None, "f", 7, False), (3, "Copy", None, None, None, None, None, None, False)]


@pytest.mark.parametrize("doc", [
    None, "", "not json", "[]", '{"value":null}', '{"value":{}}', '{"value":"x"}', "{}", '{"value":[1]}', '{"value":[[]]}',
    '{"value":[]', '{"value":[]} x', '{"value":[]}{"value":[]}', "{'value':[]}", '{"value":[],"n":"a\nb"}',
    '{"value":[{"activityName":"C"}]}', '{"value":[null]}'])
def test_malformed_documents(spark, doc):
    rows = parsed(spark, [(1, doc)]).collect()
    assert len(rows) == 1 and rows[0].is_malformed
    assert verdicts(spark, [(1, doc)], [(1, "f", 5)]) == {1: "MALFORMED"}


def test_report_without_activities_is_a_report(spark):
    rows = parsed(spark, [(1, '\n{"value": [ ]}\n')]).collect()
    assert [(r.run_id, r.activity_seq, r.is_malformed) for r in rows] == [(1, None, False)]
    assert verdicts(spark, [(1, report())], [(1, "f", 5), (2, "g", 1)]) == {1: "COUNT", 2: "NOT_REPORTED"}


def test_document_is_parsed_once(spark, capsys):
    docs = spark.createDataFrame([(1, report(copy()))], "run_id long, doc string")
    R.copy_totals(R.parse_reports(docs), ["run_id"], 0, True, "activity_seq").explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("from_json(") == 1 and plan.count("json_tuple(") == 1


# ------------------------------------------------------------------ J5
def test_total_of_all_copies_is_compared_with_data_and_control_files(spark):
    docs = [(1, report(copy(), copy(), meta("f", 5), meta("c", 2)))]
    assert verdicts(spark, docs, [(1, "f", 5)], [(1, "c", 2)]) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)], [(1, "c", 2)], LAST_COPY) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5), (1, "g", 5)], [(1, "c", 2)]) == {1: "COUNT"}


def test_mismatched_copy_counts_as_written(spark):
    docs = [(1, report(copy(2, 1), meta("f", 5)))]
    assert verdicts(spark, docs, [(1, "f", 5)], allowed=1) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)], allowed=0) == {1: "MISMATCH"}


def test_listed_file_that_the_report_does_not_name_fails(spark):
    docs = [(1, report(copy()))]
    for rule in (TOTAL_FILES, LAST_COPY):
        assert verdicts(spark, docs, [(1, "f", 5)], rule=rule) == {1: "SIZE"}


def test_reported_file_that_is_not_listed_does_not_matter(spark):
    docs = [(1, report(copy(), meta("f", 5), meta("other", 9)))]
    for rule in (TOTAL_FILES, LAST_COPY):
        assert verdicts(spark, docs, [(1, "f", 5)], rule=rule) == {1: "OK"}


def test_amounts_of_data_matter_to_the_byte_check_alone(spark):
    docs = [(1, report(copy(dr=5, dw=4), meta("f", 5)))]
    for rule in (TOTAL_FILES, LAST_COPY):
        assert verdicts(spark, docs, [(1, "f", 5)], rule=rule) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)], rule=TOTAL_BYTES) == {1: "MISMATCH"}
    assert verdicts(spark, docs, [(1, "f", 5)], rule=TOTAL_BYTES, allowed=1) == {1: "SIZE"}
    assert verdicts(spark, docs, [(1, "f", 4)], rule=TOTAL_BYTES, allowed=1) == {1: "OK"}


def test_last_metadata_of_a_name_wins(spark):
    docs = [(1, report(copy(), meta("f", 9), meta("f", 5))), (2, report(copy(), meta("f", 5), meta("f", 9)))]
    assert verdicts(spark, docs, [(1, "f", 5), (2, "f", 5)]) == {1: "OK", 2: "SIZE"}


def test_metadata_without_name_or_size_ends_the_check(spark):
    bad = [{"activityType": "GetMetadata", "activityName": GET}, {"activityType": "GetMetadata", "activityName": GET,
           "output": {"itemName": "f"}}, meta("f", "big")]
    docs = [(i, report(copy(), meta("f", 5), b)) for i, b in enumerate(bad)]
    assert set(verdicts(spark, docs, [(i, "f", 5) for i in range(3)]).values()) == {"MALFORMED"}
    other = [(1, report(copy(), meta("f", 5), {"activityType": "GetMetadata", "activityName": "Else"}))]
    assert verdicts(spark, other, [(1, "f", 5)]) == {1: "OK"}


def test_control_file_of_the_same_name_is_the_later_one(spark):
    docs = [(1, report(copy(), copy(), meta("f", 5)))]
    assert verdicts(spark, docs, [(1, "f", 9)], [(1, "f", 5)]) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)], [(1, "f", 9)]) == {1: "SIZE"}


# ------------------------------------------------------------------ J4
def test_last_copy_alone_is_compared_with_data_files(spark):
    docs = [(1, report(copy(3, 3), copy(1, 1), meta("f", 5)))]
    assert verdicts(spark, docs, [(1, "f", 5)], rule=LAST_COPY) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)], [(1, "c", 1)], rule=LAST_COPY) == {1: "OK"}
    assert verdicts(spark, docs, [(1, "f", 5)]) == {1: "COUNT"}


def test_run_without_a_counting_copy_fails_the_last_copy_check(spark):
    docs = [(1, report(meta("f", 5))), (2, report(copy(fw=None), meta("f", 5)))]
    data = [(1, "f", 5), (2, "f", 5)]
    assert verdicts(spark, docs, data, rule=LAST_COPY) == {1: "COUNT", 2: "MISMATCH"}
    assert verdicts(spark, docs, data, rule=LAST_COPY, allowed=1) == {1: "COUNT", 2: "COUNT"}


# ------------------------------------------------------------------ both
def test_null_run_is_a_run(spark):
    docs = [(None, report(copy(2, 1), meta("f", 5))), (1, report(copy(), meta("f", 5)))]
    assert verdicts(spark, docs, [(None, "f", 5), (1, "f", 5)]) == {None: "MISMATCH", 1: "OK"}


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError):
        verdicts(spark, [(1, report())], [], rule="ANY")


def as_written(doc, data, control, rule, allowed):
    """The checks of the original, activity by activity."""
    try:
        acts = json.loads(doc)["value"]
        total, last, size, tries = 0, None, {}, 0
        for a in acts:
            if a["activityType"] == "Copy":
                try:
                    o = a["output"]
                    r, w = o["filesRead"], o["filesWritten"]
                    if rule == LAST_COPY:
                        last = w
                    if rule != TOTAL_BYTES:
                        total += w
                    if r != w:
                        raise ArithmeticError
                    if rule == TOTAL_BYTES:
                        r, w = o["dataRead"], o["dataWritten"]
                        total += w
                        if r != w:
                            raise ArithmeticError
                except Exception:
                    if tries == allowed:
                        return "MISMATCH"
                    tries += 1
                    continue
            if rule != TOTAL_BYTES and a["activityType"] == "GetMetadata" and a["activityName"] == GET:
                size[a["output"]["itemName"]] = a["output"]["size"]
    except Exception:
        return "MALFORMED"
    if rule == TOTAL_BYTES:
        return "OK" if total == sum(s for _, s in data + control) else "SIZE"
    listed = data + (control if rule == TOTAL_FILES else [])
    if (last if rule == LAST_COPY else total) != len(listed):
        return "COUNT"
    return "OK" if all(size.get(n) == s for n, s in dict(listed).items()) else "SIZE"


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_are_those_of_the_original(spark, seed):
    rng = random.Random(seed)
    runs = {}
    for run in range(150):
        acts = [rng.choice([copy(), copy(), copy(2, 1), copy(dw=4), copy(fw=None), copy(dr=None), meta("a", 5), meta("b", 5),
                            meta("a", 6), meta("b", 5), meta("z", 1), meta("a", 9, "Else"), {"activityType": "Wait"}])
                for _ in range(rng.randint(0, 6))]
        data = [(n, 5) for n in "ab" if rng.random() < 0.5]
        control = [("c", 5)] if rng.random() < 0.2 else []
        acts += [meta("c", 5)] * len(control)
        runs[run] = (report(*acts), data, control)
    flat = lambda i: [(r, *f) for r, x in runs.items() for f in x[i]]
    for rule in (LAST_COPY, TOTAL_FILES, TOTAL_BYTES):
        for allowed in (0, 1):
            got = verdicts(spark, [(r, x[0]) for r, x in runs.items()], flat(1), flat(2), rule, allowed)
            assert got == {r: as_written(*x, rule, allowed) for r, x in runs.items()}


# ------------------------------------------------------------------ L2
def test_last_value_packs_any_value(spark):
    rng = random.Random(3)
    edge = [-2**63, -1, 0, 1, 2**63 - 1]
    rows = [(g, rng.choice([0, 1, 5, 2**62 - 1]), rng.choice(edge + [rng.randrange(-2**63, 2**63)])) for g in range(20)
            for _ in range(6)] + [(99, None, 1), (99, 3, None)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    got = {r.g: r.v for r in df.groupBy("g").agg(X.unpack_value(F.max(X.last_value("o", "v"))).alias("v")).collect()}
    want = {g: max((o, v) for x, o, v in rows if x == g)[1] for g in range(20)}
    assert got == {**want, 99: None}


def test_order_columns_are_packed_in_turn(spark):
    df = spark.createDataFrame([(1, 9), (2, 0), (2, 1), (0, 2**40)], "a int, b long")
    got = [tuple(r) for r in df.orderBy(X.pack_order(("a", 20), ("b", 42))).collect()]
    assert got == [(0, 2**40), (1, 9), (2, 0), (2, 1)]
    with pytest.raises(ValueError):
        X.pack_order(("a", 31), ("b", 32))


def test_reconciliation_hashes_its_aggregates(spark, sf, capsys):
    from runledger.plans import catalog

    for name in ("activity_totals", "report_totals", "activity_last_copy_count", "activity_file_compare",
                 "activity_run_verdict", "activity_last_copy_verdict", "activity_bytes_verdict"):
        catalog.Q[name](spark, sf).explain()
        plan = capsys.readouterr().out
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name
        if name.endswith("verdict"):
            assert "Join" not in plan, name
