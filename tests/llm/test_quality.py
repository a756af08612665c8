import pytest

from textharbor.llm import quality

TEXTS = [
    None, "", " \n\t", "one two", "a b c d e f g h i j k l", "same line here\n" * 9, "word " * 50,
    "### " * 12, "EVERY WORD IS LOUD AND THERE ARE MORE THAN TEN OF THEM!!", "one\n\none\n one\none\r\n",
    "a b c d e x a b c d e y a b c d e", "é é ü\x0bß " * 4, "x" * 400 + " " + " ".join("y" * 300 for _ in range(12)),
    "pa qa ra sa ta ua va wa xa ya za " * 1 + " ".join(f"word{i}" for i in range(40)), "a # $ % & | < > * b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7",
    "to be continued...\nand so on …  \nthree lines more...\nlast one of them all here.", " ".join(f"{i}" for i in range(40, 70)) + " some words",
    "\n".join(f" - item {i} of a list" for i in range(9)), "\n".join(f"- item {i} of a list" for i in range(3)),
    " ".join(f"{i % 7}{c}" for i, c in enumerate("abcdefg" * 60)), "• one two\n\tthree four five\n– six seven\n* eight nine ten eleven",
]


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(text):
    mine = words(text)
    windows = [tuple(mine[i : i + 5]) for i in range(len(mine) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(mine) < 10 or 100 * len(covered) > 20 * len(mine)
    letters, again = sum(map(len, mine)), len(lines) - len(set(lines))
    upper = sum("A" <= c <= "Z" for c in text or "")
    odd = 4 * symbols > len(mine) or 10 * again > 4 * len(lines) or 2 * upper > letters
    odd = odd or letters < 2 * len(mine) or letters > 20 * len(mine)
    cut = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    bullets = sum(x.lstrip(" ")[:1] in set("•*-–·") for x in lines)
    odd = odd or (len(lines) >= 4 and (10 * cut > 5 * len(lines) or 10 * bullets > 9 * len(lines)))
    lettered = sum(any(c.isalpha() for c in w) for w in mine)
    odd = odd or 2 * lettered < len(mine) or 50 * len(set(mine)) < len(mine)
    return len(mine), letters, symbols, again, len(covered), failed, not failed and not odd


def test_metrics_against_brute_force(spark, documents):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[4]), (4, TEXTS[4])]
    got = quality.quality_report(documents(rows)).collect()
    found = sorted(((str(r.doc_id), *r[1:]) for r in got), key=repr)
    assert found == sorted(((str(k), *brute(t)) for k, t in rows), key=repr)
    assert {r.kept for r in got} == {True, False}


def test_the_order_does_not_change_the_verdict(spark, documents):
    df = documents(list(enumerate(TEXTS)))
    verdicts = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        ordered = [quality.inlined(r) for r in rules]
        judged = quality.with_words(df, "text").select("row.doc_id", quality.cascade(ordered).alias("by"))
        verdicts.append({r.doc_id: r.by is None for r in judged.collect()})
    assert verdicts[0] == verdicts[1]
    judged = quality.judge_quality(df).select("row.doc_id", "rejected_by").collect()
    assert {r.doc_id: r.rejected_by is None for r in judged} == verdicts[0]
    assert {r.rejected_by for r in judged} <= {r.name for r in quality.RULES} | {None}


def test_rules_are_measured_and_ordered(spark, documents):
    found = quality.measured(documents([(i, t) for i in range(20) for t in TEXTS]), "text")
    assert sorted(r.name for r, _, _ in found) == sorted(r.name for r in quality.RULES)
    worth = [share / cost for _, share, cost in found if share]
    assert worth == sorted(worth, reverse=True)


@pytest.mark.parametrize("text", ["w " * 20_000, "\n".join(f"line {i % 50} of many" for i in range(5000))])
def test_very_long_texts(spark, documents, text):
    r = quality.quality_report(documents([(1, text)])).first()
    assert r.n_words == len(text.split()) and r.n_repeat_words == r.n_words and r.base_failed


def test_native_plan_and_empty_table(spark, documents):
    assert quality.quality_report(documents([])).count() == 0
    plan = quality.quality_report(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rules_behind_one_that_rejects_are_not_computed(spark, documents):
    bomb = quality.Rule("bomb", "raise_error('computed') is not null")
    rows = quality.with_words(documents(list(enumerate(TEXTS))), "text")
    first = quality.inlined(quality.Rule("all", "n_words >= 0"))
    assert {r.by for r in rows.select(quality.cascade([first, bomb]).alias("by")).collect()} == {"all"}
    with pytest.raises(Exception, match="computed"):
        rows.select(quality.cascade([bomb, first]).alias("by")).collect()


def test_the_report_computes_metrics_of_rules_inside_the_cascade(spark, documents):
    """No column below the cascade holds a metric that only a rule asks for."""
    report = quality.quality_report(documents(list(enumerate(TEXTS))))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    own = set(quality.METRICS) - set(quality.REPORTED)
    assert len(own) >= 6 and not any(f"AS {name}#" in plan for name in own)
    assert all(f"AS {name}#" in plan for name in quality.REPORTED)
    assert plan.count("[A-Z]") == 1 and plan.index("CASE WHEN base_failed") < plan.index("[A-Z]")
