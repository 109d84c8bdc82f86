"""One large index or .bib file read by many tasks."""

from duecall.sources import parsers


def test_bib_and_xml_files_are_split(spark, tmp_path):
    entries = [f"@article{{k{n},\n  title = {{On {{{n}}}\n @ home}},\n author = {{Doe, Jane and Roe, R{n}}}\n}}\n" for n in range(400)]
    (tmp_path / "one.bib").write_text("% a comment, {with} words\n" + "\n".join(entries))
    (tmp_path / "two.bib").write_text(entries[7].replace("k7", "first"))
    (tmp_path / "empty.bib").write_text("")
    xml = "".join(f"<article key='{n}'>\n<author>A{n}</author><title>T &amp; {n}</title><year>{2000 + n % 9}</year></article>\n" for n in range(400))
    (tmp_path / "toc.xml").write_text(f"<toc><articles>{xml}</articles><article><title>cut off")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        bib, toc = parsers.bibtex_files(spark, f"{tmp_path}/*.bib"), parsers.toc_files(spark, f"{tmp_path}/toc.xml")
        assert bib.rdd.getNumPartitions() > 5 and toc.rdd.getNumPartitions() > 5
        got = {r.key: r for r in bib.collect()}
        assert got.keys() == {*(f"k{n}" for n in range(400)), "first"} and got["k9"].fields == {"title": "On {9} @ home", "author": "Doe, Jane and Roe, R9"}
        assert sorted((r.title, *r.authors, r.year or 0) for r in toc.collect()) == sorted([("", 0), *((f"T & {n}", f"A{n}", 2000 + n % 9) for n in range(400))])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
