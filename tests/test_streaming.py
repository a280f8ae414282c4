import gzip

from genomes import fasta, plain_minimizers, random_dna

from strandloom.streaming.incremental import append_minimizers, contig_stream, minimizer_stream


def test_files_are_added_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        query = append_minimizers(minimizer_stream(contig_stream(spark, folder), 12, 10, 42, 10), out, checkpoint)
        query.awaitTermination()
        return spark.read.parquet(out)

    first, second = random_dna(500, 1), random_dna(300, 2) + "N" * 12 + random_dna(200, 3)
    (tmp_path / "in" / "a.fa").write_text(fasta({"x": first}))
    assert run().count() == len(plain_minimizers(first, 12, 10, 42))
    (tmp_path / "in" / "b.fasta").write_text(fasta({"y": second}))
    rows = run().collect()
    expected = {(0, p, k) for s in (first, second[:300]) for p, k in plain_minimizers(s, 12, 10, 42)}
    expected |= {(312, p, k) for p, k in plain_minimizers(second[312:], 12, 10, 42)}
    assert {(r.segment_start, r.pos, r.key) for r in rows} == expected and len(rows) == len(expected)
    assert len({r.file_id for r in rows}) == 2
    assert run().count() == len(rows)


def test_all_endings_are_taken(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["a.fna", "b.ffn", "c.fsa", "d.fa", "e.fna.gz"]
    for n, name in enumerate(names):
        data = fasta({name: random_dna(200, n)}).encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    query = contig_stream(spark, str(folder)).select("name").writeStream.format("parquet")
    query = query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == names
