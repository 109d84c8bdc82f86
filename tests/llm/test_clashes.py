"""Every operator on frames that hold all names that the operators' code uses, as columns of text."""

import re
from pathlib import Path

import corpus_pipeline
from duecall.llm import bpe, chat, common, decontamination, divergence, licenses, line_dedup, media, mixing, near_dup, pii, quality, vector_codes

SOURCE = "".join(p.read_text() for p in Path(common.__file__).parent.glob("*.py"))
NAMES = sorted({x.lower() for x in re.findall(r"[\"'(, ]([A-Za-z_][a-z0-9_]*)\b", SOURCE) if re.search(rf"[\"']{x}[\"']|\\b{x}=", SOURCE)} | {"a.b", "a`b"})
LONG = " ".join(f"w{k}" for k in range(80))
ROWS = [(1, f"head\n{LONG}\n4111111111111111", "s"), (2, f"other\n{LONG}\nend", "s"), (2, f"other\n{LONG}\nend", "s"), (3, "x", None), (4, None, "t"), (5, "", "t"), (None, LONG, "t")]


def frame(spark, own, rows, taken):
    more = [n for n in NAMES if n.lower() not in taken and n != common.ROW]
    assert len(more) > 100
    quoted = ", ".join(f"{common.name(n)} string" for n in more)
    return spark.createDataFrame([(*r, *["clash"] * len(more)) for r in rows], f"{own}, {quoted}")


def documents(spark):
    return frame(spark, "doc_id long, text string, source string", ROWS, {"doc_id", "text", "source"})


def test_operators_that_return_all_columns(spark):
    docs = documents(spark)
    items = frame(spark, "item_id long, text string", [(1, "other w0"), (2, None)], {"item_id", "text"})
    for out, own in (
        (quality.cleaned(docs), set()),
        (line_dedup.deduplicated(docs), {"removed_lines"}),
        (near_dup.representatives(docs), set()),
        (mixing.training_order(docs), set()),
        (pii.pseudonymised(docs, "key"), {"found"}),
        (licenses.scanned(docs), {"licenses"}),
        (decontamination.scanned(docs, items), {"leaks"}),
        (decontamination.clean(docs, items), set()),
    ):
        assert [c for c in out.columns if c in docs.columns] == docs.columns and set(out.columns) == set(docs.columns) | own
        rows = out.collect()
        assert rows and all(v == "clash" for r in rows for c, v in r.asDict().items() if c not in {"doc_id", "text", "source"} | own)


def test_operators_that_return_their_own_columns(spark):
    docs = documents(spark)
    assert quality.judged(docs).count() == near_dup.grouped(docs, 2).count() == mixing.mixed(docs).count() == len(ROWS)
    assert bpe.tokenised(docs).count() == media.probe(media.store(docs)).filter("error is null").count() == len(ROWS)
    assert divergence.divergence(frame(spark, "text string, lang string, source string", [("a b", "en", "s"), ("a", "en", None)], {"text", "lang", "source"}), least=1).count() == 4
    vectors = frame(spark, "vec_id long, embedding array<double>, label int", [(1, [1.0] * 8, 1), (2, [2.0] * 8, None)], {"vec_id", "embedding", "label", "code", "error", "label_error"})
    assert vector_codes.compressed(vectors)[0].count() == 2
    talk = frame(spark, "conv_id long, turn long, role string, text string", [(1, 0, "user", "hello to you all"), (1, 1, None, "> hello to you all\nhi"), (None, 0, "user", None)], {"conv_id", "turn", "role", "text"})
    assert sorted(str(r.to_turn) for r in chat.formatted(chat.quoting(talk)).collect()) == ["0", "None", "None"]


def test_stages(spark):
    docs = documents(spark)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    assert docs.count() > 0


def test_repeated_rows_have_their_own_places(spark):
    rows = [(7, "w " * 10, "a", str(k)) for k in range(20)] + [(8, "w " * 10, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    taken = [r for r in mixing.mixed(docs).collect()]
    out = mixing.training_order(docs)
    assert out.count() == sum(len(r.placements) for r in taken) and {r.extra for r in out.filter("doc_id = 7").collect()} == {"0"}
