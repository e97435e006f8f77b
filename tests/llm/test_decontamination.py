from __future__ import annotations

from corpus_cases import CLASHING, awkward, docs_of, prose

from tapeworks.llm import decontamination as d

QUESTION = ("a farmer sold 12 crates of apples to Marta for 30 dollars each and then Marta drove 45 km home with all of the crates, "
            "how many dollars did the farmer get from Marta in the end of that day")


def items(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("own"))


def pairs(spark, docs, bench):
    return {(r["doc_id"], r["item_id"]): r for r in d.leaked_pairs(docs_of(spark, docs), items(spark, bench)).collect()}


def row(i, text):
    return (i, text, "en", "s", 0)


def test_plain_and_changed_questions(spark):
    other = QUESTION.replace("12", "7").replace("Marta", "Jonas").replace("30", "18").replace("km", "miles")
    mixed_up = QUESTION.replace("to Marta", "to Jonas").replace("from Marta", "from Paula")
    docs = [row(1, prose(50, 1) + "\n" + QUESTION + "\n" + prose(50, 2)), row(2, "the story. " + other), row(3, "well, " + mixed_up), row(4, prose(200, 4)),
            row(5, " ".join(QUESTION.split()[:15])), row(6, QUESTION.upper().replace(",", ""))]
    got = pairs(spark, docs, [(10, QUESTION), (11, prose(40, 11))])
    assert (1, 10) in got and (2, 10) in got and got[1, 10]["n_changed"] == 0 and got[2, 10]["n_changed"] > 0
    assert (3, 10) not in got, "Marta stands for Jonas and for Paula"
    assert (4, 10) not in got and (5, 10) not in got


def test_changed_names_that_begin_a_sentence(spark):
    question = ("Maria buys 12 apples at the market. Maria gives 4 of them to Tom. Tom eats 2 on the way home. "
                "How many apples does Maria have left?")
    only_first = "Mark sold 9 old books on the first day. Mark kept 3 of the books for later. How many of the books did he have at first?"
    plain = "they will mark how many are left and to whom the mark of Mark and Mark and Mark was given."
    names = lambda t, **new: " ".join(next((w.replace(a, b) for a, b in new.items() if w.startswith(a)), w) for w in t.split())
    docs = [row(1, names(question, Maria="Ines", Tom="Paul").replace("12", "31")), row(2, prose(30, 1) + "\n\"" + names(question, Maria="Rose", Tom="Max") + "\""),
            row(3, names(only_first, Mark="Lena")), row(4, question.replace("How", "how")), row(5, question.replace("Maria gives", "Jonas gives").replace("Tom eats", "Olga eats"))]
    got = pairs(spark, docs, [(1, question), (2, only_first), (3, plain)])
    assert {(1, 1), (2, 1), (3, 2), (4, 1)} <= set(got) and got[4, 1]["n_changed"] == 0 and got[1, 1]["n_changed"] == 3
    assert (5, 1) not in got, "Maria stands for Maria and for Jonas"


def test_inserted_words_split_no_slot_check(spark):
    mixed = QUESTION.replace("to Marta", "to Jonas").replace("and then Marta", "and just then Paula").replace("from Marta", "from Paula")
    same = QUESTION.replace("and then", "and just then").replace("Marta", "Jonas").replace("12", "15")
    plain = QUESTION.replace("and then", "and just then")
    # asked twice with other names, each time with a word put in
    twice = same + ". " + prose(20, 3) + " " + same.replace("Jonas", "Paula").replace("15", "90")
    got = pairs(spark, [row(1, mixed), row(2, same), row(3, plain), row(4, twice)], [(10, QUESTION)])
    assert set(got) == {(2, 10), (3, 10), (4, 10)}
    n = got[2, 10]["n_windows"]
    assert [(got[i, 10]["n_matched"], got[i, 10]["n_changed"]) for i in (2, 3, 4)] == [(n - 4, 2), (n - 4, 0), (n - 4, 2)]


def test_short_items_match_as_exact_words(spark):
    bench = [(1, "12 + 30 - 4 = ?"), (2, "Who wrote Hamlet?"), (3, "one two"), (4, QUESTION), (5, "7 8 9 10 11 12 13 14")]
    docs = [row(1, prose(30, 1) + "\nQ: 12 + 30 - 4 = 38\n" + prose(30, 2)), row(2, "and \"who wrote Hamlet\" was asked"), row(3, "12 + 30 - 5 = ? 12 + 30 + 4"),
            row(4, "who once wrote Hamlet"), row(5, "it is one two"), row(10, "one two"), row(6, "x 7 8 9 10 11 12 13 14 y who wrote hamlet"), row(7, "7 8 9 10 11 12 13 15"), row(8, QUESTION), row(9, "Who wrote Hamlet?")]
    got = pairs(spark, docs, bench)
    assert set(got) == {(1, 1), (2, 2), (6, 5), (6, 2), (8, 4), (9, 2), (10, 3)}
    assert all((r["n_windows"], r["n_matched"], r["n_changed"]) == (1, 1, 0) for k, r in got.items() if k != (8, 4))


def test_matched_windows_against_a_direct_count(spark):
    """Texts without names, numbers and units: n_matched is the number of the item's distinct five-word windows that the document holds."""
    plain = lambda t: [w.strip(".").lower() for w in t.split()]
    fives = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    bench = {i: " ".join(plain(prose(45, i))) for i in range(6)}
    docs = {}
    for i, text in bench.items():
        ws = text.split()
        for k in range(5):
            docs[10 * i + k] = " ".join(plain(prose(25, 50 + i)) + ws[k * 2 : len(ws) - k] + plain(prose(9, 70 + k)) + ws[:k])
    want = {}
    for d_id, text in docs.items():
        for item, other in bench.items():
            n, k = len(fives(other.split())), len(fives(other.split()) & fives(text.split()))
            if k >= 0.8 * n:
                want[d_id, item] = (n, k)
    got = pairs(spark, [row(i, t) for i, t in docs.items()], list(bench.items()))
    assert {k: (r["n_windows"], r["n_matched"]) for k, r in got.items()} == want and len(want) > 12


def test_placeholders_alone_match_nothing(spark):
    got = pairs(spark, [row(1, "1 2 3 4 5 6 7 8 9 10 11 12"), row(2, "12 34 56 78 90 12 34 56")], [(1, "9 8 7 6 5 4 3 2 1"), (2, "1 kg 2 kg 3 kg 4 kg")])
    assert got == {}


def test_share_of_windows(spark):
    words = prose(60, 3).replace("\n", " ").split()
    docs = [row(1, " ".join(words[:50])), row(2, " ".join(words[:40])), row(3, " ".join(words[:30] + ["zzz"] + words[30:]))]
    got = pairs(spark, docs, [(5, " ".join(words))])
    n = {r["n_windows"] for r in got.values()}.pop()
    direct = [tuple(x.strip(".").lower() for x in words[i : i + 5]) for i in range(56)]
    assert n == len(set(direct)) and (1, 5) in got and (3, 5) in got and (2, 5) not in got
    assert got[1, 5]["n_matched"] == len(set(direct[:46]))


def test_awkward_rows(spark):
    rows = [*awkward(), row(700, None), row(None, "intro words here " + QUESTION), row(701, QUESTION), row(701, QUESTION)]
    bench = [(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (None, prose(40, 8)), (4, "one")]
    got = d.leaked_pairs(docs_of(spark, rows), items(spark, bench)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert {(None, 1), (701, 1)} <= found and len(got) == len(found) and not any(i in (2, 3, 4) for _, i in found)
    docs = docs_of(spark, rows)
    kept = d.drop_leaks(docs, items(spark, bench))
    left = kept.collect()
    assert kept.columns == docs.columns and all(r[c] == f"own {c}" for r in left for c in CLASHING)
    assert 701 not in {r["doc_id"] for r in left} and sum(r["doc_id"] is None for r in left) == 2 and len(left) == len(rows) - len({x for x in found}) - 1
    assert d.leaked_pairs(docs_of(spark, []), items(spark, bench)).collect() == [] and d.leaked_pairs(docs, items(spark, [])).collect() == []
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
