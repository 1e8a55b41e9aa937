"""The program from files to result files, and its sources and sinks."""

import pytest
from planted import QUERIES, SEGMENTS, R, turned
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kontig import __main__ as command
from kontig.operators import verdicts
from kontig.plans import program
from kontig.sources import catalog, sinks, text_formats


def report_text():
    out = ["ALIGNER 1.0", ""]
    for key, seq in QUERIES.items():
        out += [f"Query= q{key}", "", f"Length={len(seq)}", "", "Subject= ring the reference", "", f"Length={len(R)}", ""]
        mine = [s for s in SEGMENTS if s[0] == key]
        if not mine:
            out += ["***** No hits found *****", ""]
        for _, _, strand, q1, q2, s1, s2, gaps in mine:
            total = max(q2 - q1, abs(s2 - s1)) + 1
            q, s = seq[q1 - 1 : q2], R[min(s1, s2) - 1 : max(s1, s2)]
            s = turned(s) if strand else s
            at = 1500 if gaps else 0
            s = s[:at] + "-" * gaps + s[at:]
            out += [" Score = 1 bits (1),  Expect = 0.0", f" Identities = {total - gaps}/{total} (99%), Gaps = {gaps}/{total} (1%)", f" Strand=Plus/{'Minus' if strand else 'Plus'}", "", f"Query  {q1}  {q}  {q2}", f"Sbjct  {s1}  {s}  {s2}", ""]
        out += ["Lambda      K        H", ""]
    return "\n".join(out)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("program")
    fold = lambda s: "\n".join(s[i : i + 70] for i in range(0, len(s), 70))
    (where / "q.fa").write_text("".join(f">q{k}\tx\n{fold(s)}\n" for k, s in QUERIES.items()))
    (where / "r.fa").write_text(f">ring the reference\n{fold(R)}\n")
    pairs = [(R[p : p + 100], turned(R[p + 300 : p + 400])) for p in range(0, len(R) - 400, 10)]
    for mate in (0, 1):
        (where / f"{mate + 1}.fq").write_text("".join(f"@r{i}\n{pair[mate]}\n+\n{'I' * 100}\n" for i, pair in enumerate(pairs)))
    (where / "report.txt").write_text(report_text())
    (where / "conf").write_text(f"QUERY\n{where}/q.fa\nEND\nREF\n{where}/r.fa\nEND\nREADS\nPE={where}/1.fq {where}/2.fq\nEND\n")
    command.main(["all", "-conf", str(where / "conf"), "-o", str(where / "out"), "-report", str(where / "report.txt")])
    return where


def test_metrics_files(spark, made):
    said = dict(line.split(":", 1) for line in (next((made / "out" / "queryStatistics").glob("part-*"))).read_text().splitlines())
    said = {k.strip(): v.strip() for k, v in said.items()}
    total = sum(map(len, QUERIES.values()))
    assert (said["Queries number"], said["Total length"], said["Total ref. len"], said["Maximal length"]) == ("5", str(total), "20000", "8000")
    assert said["Perfect queries"].startswith("lenRatio=35.00 %, totalLen=7000, Num=2") and "Num=1" in said["Disjunct queries"] and "Num=1" in said["Matched queries"] and "Num=1" in said["Unmatched queries"]
    assert said["Ref. cov ratio"] == "90.00 %"
    ranked = spark.read.csv(str(made / "out" / "sortedQueries"), sep="\t", header=True, inferSchema=True).orderBy("Rank").collect()
    assert [(r.Rank, r.Query, r.Length) for r in ranked][:2] == [(1, "q2", 8000), (2, "q1", 5000)]
    kinds = spark.read.csv(str(made / "out" / "queryMatchInfo"), sep="\t", header=True).groupBy("match_kind").agg(F.sort_array(F.collect_set("title")).alias("t")).collect()
    assert {r.match_kind: r.t for r in kinds} == {"perfect": ["q1", "q4"], "matched": ["q3"], "disjunct": ["q2"], "unmatched": ["q5"]}


def test_result_files(spark, made):
    rows = {(r.query, r.result, r.mis_kind) for r in program.results(spark, str(made / "out")).collect()}
    assert rows == {("q2", "errors", "err_misjoin"), ("q3", "errors", "err_insertion"), ("q5", "errors", "err_insertion")}
    placed = program.results(spark, str(made / "out")).where("query = 'q3'").first()
    assert placed.subject == "ring" and placed.s_end - placed.s_start == 1 and abs(placed.s_start - 10_500) < 12
    cut = {r.title: r.len for r in text_formats.read_fasta(spark, str(made / "out" / "query_cor")).collect()}
    assert cut["q1"] == 5000 and cut["q4"] == 2000 and len(cut) == 6 and sum(n for t, n in cut.items() if t.startswith("q2_")) == 8002
    assert {r.key for r in spark.read.parquet(str(made / "out" / "catalog" / "verdicts")).where("verdict = 'true'").collect()} == {1, 4, 3}  # by length: q2, q5 and q3


def test_sizes_before_and_after(spark, made):
    rows = {r["name"]: (r.cnt, r.total, r.longest) for r in spark.read.csv(str(made / "out" / "sizes"), sep="\t", header=True, inferSchema=True).collect()}
    total = sum(map(len, QUERIES.values()))
    assert rows == {"before": (5, total, 8000), "after": (6, total + 2, 5000)}


def test_merged_files(spark, made):
    merged = text_formats.read_fasta(spark, str(made / "out" / "reference")).collect()
    assert [(r.title, r.seq) for r in merged] == [("ring", R)]
    assert {r.title: r.seq for r in text_formats.read_fasta(spark, str(made / "out" / "queries")).collect()} == {f"q{k}": s for k, s in QUERIES.items()}


def test_command_line():
    args = command.parser().parse_args(["misass", "-conf", "c", "-out", "o", "-m", "7", "-i", "9", "-sc"])
    assert (args.verb, args.conf, args.out, args.min_len, args.indel, args.single_cell) == ("misass", "c", "o", 7, 9, True)
    with pytest.raises(SystemExit):
        command.parser().parse_args(["other", "-conf", "c", "-o", "o"])


def test_metrics_need_a_report(spark):
    with pytest.raises(ValueError, match="report"):
        program.metrics(spark, text_formats.Config(), program.Options("nowhere"))


def test_catalog_round_trip(spark, tmp_path):
    seqs = lambda rows: spark.createDataFrame([(t, s, len(s)) for t, s in rows], "title string, seq string, len int")
    report = spark.createDataFrame([("b", 9, "s", 9, 1, 1, 4, 1, 4, 0, 4, 4, None), ("a", 9, "s", 9, None, None, None, None, None, None, None, None, None), ("gone", 9, "s", 9, 1, 1, 4, 1, 4, 0, 4, 4, 1)], "query string, query_len long, subject string, subject_len long, hsp long, q_start long, q_end long, s_start long, s_end long, strand int, match_len long, total_len long, gaps long")
    made = catalog.build(seqs([("a", "ACGT"), ("b", "ACGT"), ("c", "ACGTA")]), seqs([("s", "ACGTACG")]), report)
    catalog.save(made, str(tmp_path / "c"))
    back = catalog.load(spark, str(tmp_path / "c"))
    assert sorted((r.query_id, r.title) for r in back.queries.collect()) == [(1, "c"), (2, "a"), (3, "b")]
    assert [(r.query_id, r.subject_id, r.query_len, r.subject_len, r.gap_num) for r in back.items.collect()] == [(3, 1, 4, 7, 0)]
    with pytest.raises(PySparkException, match="twice"):
        catalog.numbered(seqs([("a", "A"), ("a", "C")]), "id").collect()


def test_read_libraries(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">a\nAC\nGT\n>b\nTT\n")
    (tmp_path / "2.fa").write_text(">a\nGG\n>b\nCC\n")
    (tmp_path / "3.fa").write_text(">a\nGG\n")
    (tmp_path / "4.fq").write_text("@a\nAC\n+\nII\n@b\nGT\n+\nII\n")
    path = lambda *names: [str(tmp_path / n) for n in names]
    rows = lambda df: sorted((r.read_id, r.pair_id, r.mate, r.seq) for r in df.collect())
    assert rows(text_formats.read_library(spark, path("1.fa", "2.fa"))) == [(1, 1, 1, "ACGT"), (2, 1, 2, "GG"), (3, 2, 1, "TT"), (4, 2, 2, "CC")]
    assert rows(text_formats.read_library(spark, path("4.fq"))) == [(1, 1, 1, "AC"), (2, 1, 2, "GT")]
    assert rows(text_formats.read_library(spark, path("4.fq", "4.fq")))[:2] == [(1, 1, 1, "AC"), (2, 1, 2, "AC")]
    with pytest.raises(PySparkException, match="differ in length"):
        text_formats.read_library(spark, path("1.fa", "3.fa")).collect()
    with pytest.raises(ValueError, match="one format"):
        text_formats.read_library(spark, path("1.fa", "4.fq"))


def test_fasta_reads_over_splits(spark, tmp_path):
    (tmp_path / "many.fa").write_text("".join(f">r{i}\n{'ACGT'[i % 4] * (i % 9 + 1)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = text_formats.read_fasta_reads(spark, str(tmp_path / "many.fa")).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.record, r.name, r.seq) for r in got] == [(i, f"r{i}", "ACGT"[i % 4] * (i % 9 + 1)) for i in range(500)]


def test_hit_table(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("# c\nq\ts\t90.0\t100\t10\t0\t1\t100\t5\t104\t1e-5\t90\nq\ts\t100.0\t50\t0\t0\t1\t50\t60\t11\t1e-9\t99\n")
    got = [(r.hsp, r.q_end, r.strand, r.match_len, r.total_len) for r in text_formats.read_hit_table(spark, str(tmp_path / "hits.tsv")).orderBy("hsp").collect()]
    assert got == [(1, 50, 1, 50, 50), (2, 100, 0, 90, 100)]


def test_labels_and_result_folders(spark, tmp_path):
    rows = [("true", "misjoin", True), ("true", "insertion", True), ("true", "deletion", False), ("sv", "misjoin", False), ("uncertain", "gap", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, verdict string, kind string, in_gap boolean").withColumn("result", verdicts.result_label()).withColumn("subject", F.when(F.col("i") == 0, "s"))
    counts = {r.result: r["count"] for r in sinks.write_results(df, str(tmp_path / "r")).collect()}
    assert counts == {"errors": 2, "gap": 1, "sv": 1, "warning": 1}
    back = spark.read.csv(str(tmp_path / "r"), sep="\t", header=True)
    assert {r.subject for r in back.collect()} == {"s", "-"} and back.where("result = 'gap'").count() == 1
