"""Reading code that does not parse."""

import time

import pytest
from pyspark.sql import functions as F

from loam.operators import code, islands


def aliases(*blocks):
    return [(i["alias"], i["module"]) for i in code.imports(list(blocks))]


def assigned(*blocks):
    return [(a["variable"], a["source"], a["index"]) for a in code.assignments(list(blocks))]


@pytest.mark.parametrize("broken", ["print x", "...", "Traceback (most recent call last):", "x = foo(1, [2", "don't", '"""', "for", "a b c", "x = }", "if a b:\n    pass"])
@pytest.mark.parametrize("before", [True, False])
def test_statements_beside_a_broken_one_are_read(broken, before):
    rest = "y, w = load(\n    'a',\n    3)\nfrom a import (b,\n   c as d)\ndef f(q,\n      r, s=1):\n    return q\nimport m.n"
    block = f"{broken}\n{rest}" if before else f"{rest}\n{broken}"
    assert aliases(block) == [("b", "a.b"), ("d", "a.c"), ("m.n", "m.n")]
    assert assigned(block) == [("y", "load", 0), ("w", "load", 1)]
    assert code.names_of_code(block)["parameters"] == ["q", "r"]


def test_only_the_broken_statement_of_a_block_goes():
    block = "class A(B):\n    @wrap\n    def m(self, k):\n        a = k.first()\n        print k\n        this is no code\n        if k:\n            b = k.second()\n        elif oops oops:\n            c = k.third()\n        else:\n            d = k.fourth()\n    e = last()\n"
    # What stands below a lost header comes behind the class that holds it.
    assert assigned(block) == [("a", "k.first", 0), ("b", "k.second", 0), ("d", "k.fourth", 0), ("e", "last", 0), ("c", "k.third", 0)]
    found = code.names_of_code(block)
    assert found["parameters"] == ["self", "k"]
    assert "wrap" in found["identifiers"] and "m" in found["identifiers"]


def test_indented_imports_are_not_at_the_top():
    assert aliases("print x\nif y:\n    import z\nimport w") == [("w", "w")]
    assert aliases("if broken here:\n    import z\nimport w") == [("w", "w")]
    assert aliases("    print x\n    import w") == [("w", "w")]


@pytest.mark.parametrize(
    "old, now",
    [("print a, b", "print(a, b)"), ("exec a", "exec(a)"), ("raise E, 'x'", "raise E('x')")],
)
def test_older_forms_are_read(old, now):
    import ast

    assert [ast.dump(s) for s in islands.statements(f"{old}\nbroken line")[0]] == [ast.dump(s) for s in ast.parse(now).body]


def test_older_except_and_headers_without_a_body():
    assert assigned("try:\n    a = f()\nexcept E, e:\n    b = g()") == [("a", "f", 0), ("b", "g", 0)]
    assert code.names_of_code("for i, j in pairs:\nbroken line")["loop_targets"] == ["i", "j"]
    assert code.names_of_code("def f(a, b):\nbroken line")["parameters"] == ["a", "b"]


def test_strings_and_brackets_over_lines():
    assert assigned('s = g("""one\nimport no\n( [""")\nbroken line\nt = h(\'(\')') == [("s", "g", 0), ("t", "h", 0)]
    assert aliases('s = """one\nimport no\n"""\nbroken line') == []
    assert assigned("a = f(1, \\\n  2)\nb = \\\n  g()\nbroken line") == [("a", "f", 0), ("b", "g", 0)]


def test_wholly_parsed_code_is_read_as_before():
    whole = "import a\nif x:\n    import b\n"
    top, inner = islands.statements(whole)
    assert len(top) == 2 and inner == []


@pytest.mark.parametrize("text", ["", None, "\n\n", "(\n" * 3000, '"""\n' * 3000, "'" * 100000, "if x:\n" * 3000 + "@", "".join(" " * k + "if x:\n" for k in range(300)) + "!", "\tx = 1\n  y = 2\n!", "\x00\n!"])
def test_odd_and_long_texts_end(text):
    began = time.perf_counter()
    code.imports([text])
    code.names_of_code(text)
    assert time.perf_counter() - began < 20


BLOCKS = ["import a as b\nx = b.f()\ndef g(q):\n    return q", "print x\ny, z = load(\n  1)\nif no no:\n    w = k.go()\ndef h(r, s=1):\n    pass", "# note\n...\nfor i, j in k:\n    m[0] = f()\nfrom n import *\nown()", "plain words", "", None]


def test_one_reading_finds_what_separate_ones_do():
    whole = code.everything(BLOCKS)
    assert whole == {"imports": code.imports(BLOCKS), "assigns": code.assignments(BLOCKS), "names": [code.names_of_code(b) for b in BLOCKS]}
    assert whole["imports"] and whole["assigns"] and whole["names"][1]["parameters"] == ["r"]
    assert code.everything(None) == {"imports": [], "assigns": [], "names": []}


def test_code_is_read_once_and_by_all_cores(spark, tmp_path):
    """A small file is one task's; its rows are dealt before they go to Python."""
    from loam.plans import catalogue

    rows = spark.range(40).selectExpr("id AS p_partkey", "'ab cd' AS p_name", "'TIN' AS p_type", "CAST(id % 7 AS int) AS p_size", "'Brand#1' AS p_brand")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES["c1_c4_c6_broken_code"](spark, str(tmp_path))
    assert found.count() == 8 * 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name", ["c13_names", "c2_star_imports", "c4_assignments", "a4_variables", "c1_imports", "t11_part_tokens", "e3_long_chunks", "e2_candidates", "t12_places", "t9_prompts"])
def test_python_works_on_parts_in_several_tasks(spark, tmp_path, name):
    from loam.plans import catalogue

    rows = spark.range(40).selectExpr("id AS p_partkey", "'ab cd' AS p_name", "'TIN' AS p_type", "CAST(id % 7 AS int) AS p_size", "'Brand#1' AS p_brand")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression [p_partkey")
    assert plan.count("ArrowEvalPython") <= 2
