from duecall.llm import quality

SCHEMA = "doc_id long, text string, source string, line string"


def words(k, n=25):
    return " ".join(f"d{k}x{j}" for j in range(n))


def test_boilerplate_copies_and_depletion(spark):
    rows = [(k, f"Home  Page\n{words(k)}\nfoot {k}", "a") for k in range(30)]
    rows += [(100 + k, f"home page\n{words(k)}", "b") for k in range(20)]
    rows += [(200 + k, f"{words(999)}\n{words(998)}", "c") for k in range(60)]
    rows += [(300, "\n".join(["Home page"] * 14 + ["last word of it"]), "a"), (301, None, "a"), (302, "", "a"), (303, words(5), None), (303, words(5), None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {}
    for r in quality.judged(df).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[k].kept and got[k].n_removed_lines == 1 and got[k].words_left == 27 for k in range(30))
    assert all(got[100 + k].kept and got[100 + k].n_removed_lines == 0 for k in range(20))
    assert all(got[200 + k].kept for k in range(60))
    assert not got[301].kept and not got[302].kept and got[302].n_words == 0 and got[303].kept
    assert got[300].n_dup_lines == 13 and got[300].base_failed
    out = {r.doc_id: r.text for r in quality.cleaned(df).collect()}
    assert out[0] == f"{words(0)}\nfoot 0" and out[100] == f"home page\n{words(0)}" and 301 not in out


def test_block_of_lines_with_the_same_neighbours(spark):
    block = ["cookie notice", "we use cookies", "read our policy", "all rights reserved"]
    rows = [(k, "\n".join([words(k), *block]), "a") for k in range(26)] + [(100 + k, "\n".join([words(k), *block]), "b") for k in range(25)]
    rows += [(200 + k, "\n".join([" ".join(block * 10), words(k, 5)]), "d") for k in range(26)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert all(got[k].kept and got[k].n_removed_lines == 4 and got[k].words_left == 25 for k in range(26))
    assert all(got[100 + k].n_removed_lines == 0 for k in range(25))
    assert all(got[200 + k].n_removed_lines == 1 and not got[200 + k].kept for k in range(26))
    assert {r.doc_id: r.text for r in quality.cleaned(df).collect()}[0] == words(0)


def test_repeat_words_as_brute_force(spark):
    texts = ["a b c d e f g h " * 3, "a " * 9, "a " * 8, words(1) + " " + words(1)[:40], "x y " * 10 + words(2), words(3, 3000) + " a" * 20]
    df = spark.createDataFrame([(k, t, "s", "") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_repeat_words for r in quality.measured(df).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        assert got[k] == len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}), k


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.judged(df).count() == 0 and quality.cleaned(df).count() == 0
