import json
import os

import pytest
from pyspark.sql import functions as F

from textloom import job
from textloom.functions import sql as S
from textloom.functions import tables as T
from textloom.functions.detect import Options
from textloom.operators import detection as D
from textloom.operators import profiles as P
from textloom.sources import files as files
from textloom.streaming.detect import write_detected

RUSSIAN = "Старый город стоит на берегу реки, и летом сюда приезжают люди. Они гуляют по набережной. " * 4
PAYLOADS = [(1, b"plain ascii text"), (2, "été à la plage".encode()), (3, RUSSIAN.encode("cp1251")), (4, b"\x00\x5f\x2f\xff" * 50), (5, b""), (6, None), (7, b"\xef\xbb\xbfmarked"), (8, '<meta charset="cp1252">déjà vu, très bien'.encode("cp1252"))]


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in PAYLOADS], "id int, payload binary")


def test_best_and_partitions(payloads):
    best = {r.id: r.best for r in D.detect_best(payloads).collect()}
    again = {r.id: r.best for r in D.detect_best(payloads.repartition(5)).collect()}
    assert best == again
    assert [best[i] and best[i].encoding for i in range(1, 9)] == ["ascii", "utf_8", "cp1251", None, "utf_8", None, "utf_8", "cp1252"]
    assert best[7].bom and best[8].declared == "cp1252" and best[3].language in T.target_languages("cp1251")


def test_matches_and_rows(payloads):
    rows = D.all_matches(payloads).where("id = 3").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows))) and rows[0].could_be_from[0] == "cp1251"
    found = {r.id: r for r in D.charset_matches(payloads).collect()}
    assert found[4].matches == [] and found[6].matches is None and any("Unable" in t.message for t in found[4].trace)


def test_binary_legacy_and_normalize(payloads):
    flags = {r.id: r.is_binary for r in D.with_binary_flag(payloads).collect()}
    assert flags[4] and not flags[1] and flags[6] is None
    legacy = {r.id: r for r in D.legacy_detect(payloads).collect()}
    assert legacy[7].encoding == "UTF-8-SIG" and legacy[4].encoding is None and legacy[1].confidence == 1.0
    out = {r.id: r for r in D.normalize(payloads).collect()}
    assert out[3].output_text == RUSSIAN and b'charset="utf-8"' in bytes(out[8].output) and out[4].output is None


def test_options_reach_the_kernel(payloads):
    only = D.detect_best(payloads.where("id = 3"), options=Options(only=("koi8-r",))).first().best
    assert only is None or only.encoding == "koi8_r"


def test_native_columns(payloads):
    got = {r.id: r for r in payloads.select("id", P.bom_encoding("payload").alias("bom"), P.declared_encoding("payload").alias("declared"), P.is_ascii("payload").alias("ascii"), P.is_valid_utf8("payload").alias("utf8")).collect()}
    assert got[7].bom == "utf_8" and got[1].bom is None and got[8].declared == "cp1252" and got[1].ascii and not got[2].ascii and got[2].utf8 and not got[3].utf8 and got[6].bom is None


def test_declarations_are_those_of_the_kernel(spark):
    from textloom.functions.detect import declared_encoding

    cases = [b'<?xml encoding="EUC-JP"?>', b"coding: utf-57 charset=latin1", "é charset='koi8-r'".encode("latin_1"), b"CHARSET=UTF-8", b"x" * 8190 + b"charset=utf-8", b"", b"charset==:  :windows-1250"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, payload binary")
    assert [r.d for r in df.orderBy("i").select(P.declared_encoding("payload").alias("d")).collect()] == [declared_encoding(c) for c in cases]


def test_ratios_and_folding(spark):
    df = spark.createDataFrame([(1, "English", 0.5), (1, "English—", 0.8), (1, "French", 0.2), (2, "Japanese—", 0.4)], "id int, language string, ratio double")
    got = sorted((r.id, r.language, r.ratio) for r in P.fold_alternatives(df, ["id"]).collect())
    assert got == [(1, "English", 0.8), (1, "French", 0.2), (2, "Japanese—", 0.4)]
    assert sorted((r.language, r.ratio) for r in P.merge_coherence(df.where("id = 1"), []).collect())[0] == ("English", 0.5)


def test_submatches(spark):
    df = spark.createDataFrame([(1, 3, "cp1254", 0.0, "a"), (1, 2, "cp1252", 0.0, "a"), (1, 4, "cp1250", 0.1, "a")], "id int, ordinal int, encoding string, chaos double, text string")
    assert sorted((r.encoding, r.could_be_from) for r in P.fold_submatches(df, ["id"]).collect()) == [("cp1250", ["cp1250"]), ("cp1252", ["cp1252", "cp1254"])]


def test_sql(spark, payloads):
    S.register(spark)
    payloads.createOrReplaceTempView("payloads")
    rows = spark.sql("SELECT id, m.* FROM payloads, LATERAL charset_matches(payload) m WHERE m.rank = 0 ORDER BY id").collect()
    assert [r.encoding for r in rows if r.id == 3] == ["cp1251"]
    row = spark.sql("SELECT detect_encoding(payload) AS e, is_binary(payload) AS b, decode_best(payload) AS t FROM payloads WHERE id = 2").first()
    assert tuple(row) == ("utf_8", False, "été à la plage")
    row = spark.sql("SELECT mess_ratio('plain') AS m, coherence_ratio(repeat('the quick brown fox jumps over the lazy dog ', 9)) AS c, alphabets('aя') AS a").first()
    assert row.m == 0.0 and row.c and row.a == ["Basic Latin", "Cyrillic"]


def test_code_pages(spark):
    pages = P.code_pages(spark).where(F.col("encoding").isin("cp1252", "latin_1"))
    got = {(r.a, r.b): r.similarity for r in P.code_page_similarity(pages).collect()}
    assert got[("cp1252", "latin_1")] == T.similarity("cp1252", "latin_1")


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a.txt", RUSSIAN.encode("cp1251")), ("b.sub.txt", "été".encode()), ("c", b"\x00\x5f\x2f\xff" * 50)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_files_and_sink(spark, folder):
    df = files.read_files(spark, f"{folder}/in")
    report = {os.path.basename(r.path): r for r in D.report_rows(df).collect()}
    assert report["a.txt"].encoding == "cp1251" and report["c"].encoding is None and report["c"].chaos == 1.0
    done = {os.path.basename(r.path): r.unicode_path for r in files.write_normalized(df, folder=f"file:{folder}/out").collect()}
    assert done["b.sub.txt"] is None and done["c"] is None
    assert (folder / "out" / "a.cp1251.txt").read_text("utf-8") == RUSSIAN
    assert files.normalized_path("/x/a.b.txt", "cp1252") == "/x/a.b.cp1252.txt" and files.normalized_path("x", "cp1252") == "x.cp1252"


def test_stream(spark, folder):
    query = write_detected(spark, f"{folder}/in", f"{folder}/found", f"{folder}/state")
    assert query.awaitTermination(120)
    got = {os.path.basename(r.path): r.encoding for r in spark.read.parquet(f"{folder}/found").collect()}
    assert got == {"a.txt": "cp1251", "b.sub.txt": "utf_8", "c": None}


def test_job(spark, folder, capsys):
    assert job.main([f"{folder}/in/a.txt"], spark) == 0
    row = json.loads(capsys.readouterr().out)
    assert row["encoding"] == "cp1251" and row["is_preferred"] and list(row)[1] == "encoding"
    assert job.main(["-m", f"{folder}/in/a.txt", f"{folder}/in/c"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["cp1251", "undefined"]
    assert job.main(["-r", "x"], spark) == job.main(["-n", "-f", "x"], spark) == job.main(["-t", "1.5", "x"], spark) == 1
    assert job.main(["-n", f"{folder}/in/a.txt"], spark) == 0
    assert (folder / "in" / "a.cp1251.txt").read_text("utf-8") == RUSSIAN


def test_job_reads_the_standard_input(spark, folder, capsys, monkeypatch):
    import io
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(RUSSIAN.encode("cp1251"))))
    assert job.main(["-n", "-", f"{folder}/in/b.sub.txt"], spark) == 0
    rows = {r["path"].rpartition("/")[2]: r for r in json.loads(capsys.readouterr().out)}
    assert rows["-"]["encoding"] == "cp1251" and rows["-"]["unicode_path"] is None and rows["b.sub.txt"]["encoding"] == "utf_8"


def test_job_writes_and_reports_in_one_pass(spark, folder, capsys):
    assert job.main(["-n", "-a", f"{folder}/in/a.txt"], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    rows = rows if isinstance(rows, list) else [rows]
    assert rows[0]["is_preferred"] and rows[0]["unicode_path"].endswith("a.cp1251.txt") and not any(r["is_preferred"] for r in rows[1:])


def test_evaluation(spark):
    from textloom.operators import evaluation as E

    rows = [(1, RUSSIAN.encode("cp1251"), "windows-1251"), (2, "été".encode(), "utf-8"), (3, b"\x00\x5f\x2f\xff" * 50, None), (4, b"plain text", "latin-1"), (5, RUSSIAN.encode("cp1251"), "koi8-r"), (6, b"plain", None)]
    df = spark.createDataFrame(rows, "id int, payload binary, expected string")
    got = {r.id: r for r in E.evaluated(df, "expected").collect()}
    assert [got[i].success for i in range(1, 7)] == [True, True, True, True, False, False] and got[4].equivalence == 1.0
    total = E.coverage(E.evaluated(df, "expected")).first()
    assert (total.total, total.successes) == (6, 4)
    assert {r.id: r.success for r in E.compared(df, "expected").collect()}[1]
    times = E.timed(df, keep=["id"], size_factor=2, most_bytes=100)
    row = E.latency(times).first()
    assert row.n == 6 and 0 < row.least <= row.p50 <= row.p95 <= row.p99 <= row.most and E.slowest(times, 2).count() == 2


def test_trials(spark):
    df = spark.createDataFrame([(1, "été à la mer, où l'été fut beau".encode("cp1252"))], "id int, payload binary")
    got = {r.encoding: r for r in D.trials(df, keep=["id"]).collect()}
    assert not got["utf_8"].valid and got["cp1252"].valid and not got["cp1252"].rejected and got["ascii"].ordinal == 0 and len(got) > 80


def test_folding_moves_digests_and_no_texts(spark):
    rows = [(1, 0, "a", 0.0, "x"), (1, 1, "b", 0.0, "x"), (1, 2, "c", 0.5, "x"), (1, 3, "d", 0.0, "X"), (2, 0, "a", 0.0, None), (2, 1, "b", 0.0, None), (2, 2, "c", 0.0, "")]
    folded = P.fold_submatches(spark.createDataFrame(rows, "id int, ordinal int, encoding string, chaos double, text string"), ["id"])
    assert sorted((r.id, r.ordinal, r.encoding, r.chaos, r.could_be_from) for r in folded.collect()) == [(1, 0, "a", 0.0, ["a", "b"]), (1, 2, "c", 0.5, ["c"]), (1, 3, "d", 0.0, ["d"]), (2, 0, "a", 0.0, ["a", "b"]), (2, 2, "c", 0.0, ["c"])]
    exchanges = [x for x in folded._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert exchanges and not any("text#" in x.split("[", 2)[1] for x in exchanges)


def test_payloads_are_judged_side_by_side_up_to_a_size(monkeypatch):
    from textloom.operators import detection

    monkeypatch.setattr(detection, "TOGETHER_BYTES", 10)
    payloads = [b"aaaa", None, b"bbbb", b"cccc", b"", b"d" * 30, b"e", b"f" * 10]
    assert [list(x) for x in detection.together(payloads)] == [[0, 1, 2], [3, 4], [5], [6], [7]]


def test_equivalence_counts_places_that_differ():
    from textloom.operators.evaluation import equivalence

    assert equivalence(b"caf\xe9 \xa4", "cp1252", "iso8859_15") == 1 - 1 / 6 and equivalence(b"abcd", "latin_1", "utf_16_le") == 1 - 2 / 4
