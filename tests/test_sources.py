from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.plans import audits
from ledgerlens.sources import contracts as C
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import ingest

HEAD = C.SUMMARY.fieldNames()


def summary_row(**change):
    base = dict(zip(HEAD, ["1ABC", "H", "NA", "0", "A | B", "protein", "Toxin", "04/15/70", "x", "Homo Sapiens", "NA", "None", "2.5", "X-RAY", "IGHV1", "unknown", ""])) | change
    return [base[h] for h in HEAD]


@pytest.mark.parametrize("sep", ["\t", ",", ";"])
def test_delimited(spark, tmp_path, sep):
    rows = [summary_row(), summary_row(pdb=""), summary_row(pdb="2xyz", Hchain=""), summary_row(pdb="3DEF", resolution="NA", model="H")]
    path = tmp_path / "s.txt"
    path.write_text("\n".join(sep.join(r) for r in [HEAD, *rows]) + "\n")
    uri = f"file://{path}"
    assert readers.detect_delimiter(spark, uri) == sep
    got = {r["pdb_id"]: r for r in readers.read_summary(spark, uri).collect()}
    assert set(got) == {"1abc", "3def"} and got["1abc"]["l_chain"] == "NA" and got["1abc"]["light_species"] is None and got["1abc"]["year"] == 1970
    assert got["1abc"]["filename_stem"] == "1abc_agA _ B_m0" and got["3def"]["resolution"] is None and got["1abc"]["resolution"] == 2.5
    with pytest.raises(C.ContractError):
        readers.read_delimited(spark, uri, ["absent"], "x")
    with pytest.raises(FileNotFoundError):
        C.require_path(spark, f"file://{tmp_path}/none", "x")


def test_therapeutics_and_build(spark):
    row = ["mab", "f", "t", "s", "1abc:HL;2abc:H", "1abc:HL", "na", "tg", "g"]
    wide = spark.createDataFrame([row], C.THERAPEUTICS)
    long = readers.therapeutic_rows(wide)
    assert sorted((r["tier"], r["pdb_id"], r["h_chain"], r["l_chain"]) for r in long.collect()) == [("100", "1abc", "H", "L"), ("100", "2abc", "H", "NA"), ("99", "1abc", "H", "L")]
    summary = readers.summary_rows(spark.createDataFrame([summary_row(pdb="1abc", Lchain="L", antigen_chain="A"), summary_row(pdb="9zzz", Lchain="L", antigen_chain="Q")], C.SUMMARY))
    samples = spark.createDataFrame([("1abc_agA_m0", "1abc"), ("9zzz_agOTHER_m0", "9zzz"), ("none_agA_m0", "none")], "filename_stem string, pdb_id string")
    master = audits.master_table(samples, summary, long)
    got = {r["pdb_id"]: (r["match"], r["tier"], r["is_therapeutic"]) for r in master.collect()}
    assert got == {"1abc": ("exact", "100", True), "9zzz": ("fallback", None, False), "none": ("none", None, False)}
    assert tuple(audits.build_report(master).first()) == (3, 1, 1, 1)


def test_structures(spark, tmp_path):
    line = lambda n, name, res, chain, num, icode, x: f"ATOM  {n:5d}  {name:<3s} {res:>3s} {chain}{num:4d}{icode}   {x:8.3f}{0:8.3f}{0:8.3f}"
    text = "\n".join(["REMARK x", "MODEL        1", line(1, "CA", "ALA", "H", 2, " ", 1.0), line(2, "CA", "GLY", "H", 1, " ", 2.0), line(3, "CA", "SER", "H", 2, "A", 3.0), line(4, "CA", "SER", "H", 200, " ", 4.0), "ENDMDL", "MODEL        2", line(5, "CA", "ALA", "H", 1, " ", 9.0)])
    (tmp_path / "1abc.pdb").write_text(text)
    atoms = readers.read_structures(spark, f"file://{tmp_path}")
    assert atoms.count() == 5 and {r["model"] for r in atoms.collect()} == {0, 1}
    r = readers.variable_domain(atoms).where("model = 0").first()
    assert [(x["letter"], round(x["position"], 1)) for x in r["residues"]] == [("G", 1.0), ("A", 2.0), ("S", 2.1)]
    lines = spark.createDataFrame([("p", i, v) for i, v in enumerate(text.split("\n"))], "pdb_id string, line int, value string")
    assert readers.atom_counts(lines).first()["atoms"] == 5 and readers.grep_lines(lines, "^MODEL").first()["lines"][1].split() == ["MODEL", "2"]


def test_fasta_headers_and_manifests(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">g1 note\nAC\nGT\n>g2\nTT\n")
    assert {(r["gene_id"], r["seq"]) for r in readers.read_fasta(spark, f"file://{tmp_path}/a.fasta").collect()} == {("g1", "ACGT"), ("g2", "TT")}
    heads = ['{"Species": "human", "Run": 1}', "{'Species': 'mouse', 'Run': None}", "broken"]
    (tmp_path / "h").mkdir()
    for i, h in enumerate(heads):
        with gzip.open(tmp_path / "h" / f"{i}.csv.gz", "wt") as f:
            f.write(h + "\ndata,1\n")
    rows = readers.read_headers(spark, f"file://{tmp_path}/h", "Species", "Absent")
    assert {(r["species"], r["n"]) for r in audits.header_species(rows).collect()} == {("human", 1), ("mouse", 1), ("UNREADABLE", 1)}
    assert {r["Absent"] for r in rows.collect()} == {"MISSING"}
    manifest = spark.createDataFrame([('{"train": ["a_b_c_d", "x"], "test": ["y"]}',)], "value string")
    assert {(r["split"], r["id"]) for r in readers.manifest_rows(manifest).collect()} == {("train", "a_b_c_d"), ("train", "x"), ("test", "y")}


def test_repertoire(spark, tmp_path):
    meta = {"total_samples": 2, "max_len": 5, "source_map": {"a": 0}, "source_counts": {"a": 2}, "has_clono_hash": True}
    for name in ("train", "val"):
        spark.range(50).selectExpr("CAST(0 AS SHORT) AS source_id", "CAST(5 + id % 7 AS SHORT) AS cdr3_len", "id AS clono_hash").write.parquet(f"file://{tmp_path}/{name}/data")
        (tmp_path / name / "meta.json").write_text(json.dumps(meta))
    df, got = readers.read_repertoire(spark, f"file://{tmp_path}")
    assert df.count() == 100 and got["capabilities"] == {"has_clono_hash": True, "has_cdr3_len": False}
    assert audits.unique_fraction(df).first()["unique_fraction"] == 0.5
    master = spark.createDataFrame([(" Human", 5 + i % 7) for i in range(70)], "heavy_species string, cdr3_len_actual int")
    assert 0 <= audits.repertoire_divergence(master, df, 60).first()["jsd"] < 0.05
    with pytest.raises(C.ContractError):
        C.check_meta({})
    with pytest.raises(C.ContractError):
        C.same_schema([meta, meta | {"max_len": 6}])


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/r.json"
    sinks.merge_json(spark, path, {"a": {"x": float("nan")}, "b": 1})
    assert sinks.merge_json(spark, path, {"b": 2, "d": dt.date(2024, 1, 2)})["b"] == 2
    assert readers.read_json_object(spark, path) == {"a": {"x": None}, "b": 2, "d": "2024-01-02"}
    assert readers.read_json_object(spark, path + "x") is None and readers.probe({"a": {"b": 1}}, "z", "a.b") == 1
    df = spark.createDataFrame([("h1", "AC"), ("h1", "AB"), ("h2", "T")], "hash string, seq string")
    sinks.write_fasta(df, f"file://{tmp_path}/f")
    assert {(r["gene_id"], r["seq"]) for r in readers.read_fasta(spark, f"file://{tmp_path}/f").collect()} == {("h1", "AB"), ("h2", "T")}
    assert [sinks.new_version(df, f"file://{tmp_path}/t")[-6:] for _ in range(2)] == ["v00001", "v00002"]
    assert sinks.not_yet_done(df, df.where("hash = 'h1'"), "hash").count() == 1
    assert sinks.patched(df.select("seq"), spark.createDataFrame([("T", "c")], "seq string, c string"), "seq", "c").where("c IS NOT NULL").count() == 1
    with pytest.raises(C.ContractError):
        sinks.patched(df, spark.createDataFrame([("h1", 1), ("h1", 2)], "hash string, c int"), "hash", "c")
    assert "## s\n\nbody" in sinks.write_markdown(spark, f"file://{tmp_path}/m.md", "t", [("s", "body")])


def test_probe_files(spark, tmp_path):
    found = lambda: readers.probe_files(spark, f"file://{tmp_path}/r*.json", "C.rows", "top.A.rows")
    assert found() is None
    (tmp_path / "r1.json").write_text('{"C": {"rows": [1')
    (tmp_path / "r2.json").write_text('{"C": {"rows": null}, "other": 1}')
    (tmp_path / "x0.json").write_text('{"C": {"rows": [9]}}')
    assert found() is None
    (tmp_path / "r4.json").write_text('{"C": {"rows": [4]}}')
    (tmp_path / "r3.json").write_text('{\n "top": {"A": {"rows": [{"aa": "A", "share": 0.5}]}}}')
    file, path, value = found()
    assert file.endswith("r3.json") and path == "top.A.rows" and value == [{"aa": "A", "share": 0.5}]


def test_versions_count_what_was_written(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert sinks.new_version(empty, f"file://{tmp_path}/e").endswith("v00001")
    calls = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    df = spark.range(100).repartition(3).mapInPandas(seen, "id long")
    path = sinks.new_version(df, f"file://{tmp_path}/n")
    assert spark.read.parquet(path).count() == 100 and calls.value == 100


def test_contracts(spark):
    df = spark.createDataFrame([("p", True, None)], "pdb_id string, paired boolean, heavy string")
    with pytest.raises(C.ContractError):
        C.require_fields(df)
    assert C.require_fields(df, ("pdb_id", "heavy")).first()["schema_error"] == "missing heavy"
    with pytest.raises(C.ContractError):
        C.require_count(df, 2, "x")
    assert T.normalize_nulls(spark.createDataFrame([("NA", "b ")], "a string, b string")).first() == (None, "b")


def test_streaming(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"t{i % 4}", at + dt.timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(rows, "id long, text string, at timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = lambda: ingest.stream_table(spark, f"file://{tmp_path}/in", "id long, text string, at timestamp")
    for _ in range(2):
        ingest.run_once(ingest.unique_within(stream(), "text", "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/c1")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    ingest.run_funnel(stream().withColumn("stage", F.col("text")), "stage", f"file://{tmp_path}/fun", f"file://{tmp_path}/c2")
    assert spark.read.parquet(f"file://{tmp_path}/fun").agg(F.sum("n")).first()[0] == 20
    ingest.run_once(ingest.windowed_counts(stream(), "at", "5 minutes", "1 minute"), f"file://{tmp_path}/win", f"file://{tmp_path}/c3")
    assert spark.read.parquet(f"file://{tmp_path}/win").count() >= 3
