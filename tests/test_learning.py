import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from spendalloc.functions.text import name_norm
from spendalloc.operators import ledgers as L
from spendalloc.operators import measure as M
from spendalloc.operators import roster as R
from spendalloc.streaming import flows
from tests.fixtures import JUL, lines, snap

D = dt.date
STAFF = [("100", "YILMAZ AHMET", "A", JUL, {"birth_date": D(1980, 1, 1)}), ("200", "YILMAZ AHMET", "A", JUL, {"birth_date": D(1990, 5, 5)}),
         ("300", "KAYA VELI", "B", JUL, {"birth_date": D(1975, 3, 3)})]


def health(spark, rows):
    return lines(spark, [dict(source_type="health", person_raw=p, national_id_raw=n) for p, n, _ in rows]).join(
        spark.createDataFrame([(i + 1, b) for i, (_, _, b) in enumerate(rows)], "row_no bigint, birth_date date"), "row_no")


def test_bridge(spark):
    s = snap(spark, STAFF)
    ids, last = R.name_index(s), R.latest(s)
    h = health(spark, [("Ahmet Yilmaz", "11111111111", D(1990, 5, 5)), ("Ahmet Yilmaz", "22222222222", D(2000, 12, 12)),
                       ("Veli Kaya", "33333333333", None)])
    got = {r["national_id"]: r["staff_id"] for r in L.derive_bridge(h, ids, last).collect()}
    assert got == {"11111111111": "200"}
    free = {r["national_id"]: r["confidence"] for r in L.derive_bridge(h, ids, last, require_birth=False).collect()}
    assert free == {"11111111111": 0.97, "33333333333": 0.70}
    one = L.bridge_summary(h, ids, L.derive_bridge(h, ids, last)).head()
    assert (one["n_persons"], one["n_found"], one["n_bridged"], one["n_absent"]) == (3, 3, 1, 0)


def test_alias(spark):
    s = snap(spark, STAFF)
    last = R.latest(s).withColumn("latest_norm", name_norm("full_name"))
    h = health(spark, [("KAYE VELI", None, D(1975, 3, 3)), ("SOMEBODY ELSE", None, D(1975, 3, 3)), ("KAYA VELI", None, D(1975, 3, 3))])
    assert [(r["name_norm"], r["staff_id"]) for r in L.derive_alias(h, R.name_index(s), last).collect()] == [("KAYE VELI", "300")]


def test_causes(spark):
    roster = R.build_roster(snap(spark, STAFF))
    df = lines(spark, [dict(person_raw="", description="CENAZE CELENGI"), dict(person_raw="", description="AHMET BEY ICIN"),
                       dict(person_raw="VELI KAYA"), dict(person_raw="KAYA ZZZ"), dict(person_raw="QQQQ WWWW")])
    df = df.withColumns({"decision": F.lit("UNMATCHED"), "method": F.lit("none"), "candidates": F.array().cast("array<string>")})
    got = {r["row_no"]: r["cause"] for r in M.unmatched_causes(df, roster).collect()}
    assert got == {1: "no_person", 2: "parser", 3: "algorithm", 4: "algorithm", 5: "out_of_data"}


def test_late_lines(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id int, arrived timestamp"
    t = lambda h: dt.datetime(2026, 7, 1, h)

    def send(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{n}")
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        flows.route_late(s, out, str(tmp_path / "cp")).awaitTermination()

    send(0, [(1, t(10)), (2, t(9))])
    send(1, [(3, t(8)), (4, t(11))])
    got = {r["id"]: r["is_late"] == "true" for r in spark.read.parquet(f"{out}/lines").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_merge_reads_and_deals_the_roster_once(spark, tmp_path):
    from spendalloc.plans.names import ledger_merge
    docs = [(i, f"Ali Veli {'abcdefgh'[i % 8]}x Kaya Han {'stuvw'[i % 5]}y", "s", "en", 20) for i in range(40)]
    for turn in (0, 1):
        path = tmp_path / str(turn)
        spark.createDataFrame(docs[turn:], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(
            str(path / "documents.parquet"))
        out = ledger_merge(spark, str(path))
        rows = {r["name_norm"]: (r["staff_id"], r["source"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") <= 1
        newest = {}
        for i, text, *_ in docs[turn:]:
            w = text.upper().split(" ")
            for n, name in enumerate((" ".join(w[:3]), " ".join(w[3:]))):
                newest[name] = i * 1_000_000 + n
        want = {k: (f"H{v}", "human") if v % 5 == 0 else (str(v), "old") if v % 3 == 0 else (f"N{v}", "derived")
                for k, v in newest.items()}
        assert rows == want


def test_documents_are_dealt_out_and_read_once(spark, sf):
    from spendalloc.plans import names, views

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # Few tasks read a compressed file of texts; the names are unfolded by as many as there is data.
    r = plan(views.roster(spark, sf, deal=True))
    assert r.index("Generate") < r.index("hashpartitioning(doc_id") < r.index("FileScan")
    # Neither names nor ids go back to the documents.
    for q in (names.bridge_derive, names.bridge_summary, names.ledger_feed, names.ledger_report):
        assert "documents.parquet" not in q(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "documents.parquet" not in plan(q(spark, sf))
