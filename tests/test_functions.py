from __future__ import annotations

import ast

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeprint.functions import paths, pycode, text
from codeprint.operators.features import FEATURE_SETS
from codeprint.plans import catalogue


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_years(spark):
    names = ["aoc2021/x.py", "aoc-2021/x.py", "AdventOfCode2021/x.py", "AdventOfCode24/x.py", "aoc24/x.py", "advent-of-code-2024/x", "advent_of_code_21/x", "adventofcode202/x", None]
    assert column(spark, names, paths.infer_year) == ["2020", "2020", "2021", "2024", "2024", "2024", None, "202", None]
    assert column(spark, names[:2], lambda c: paths.infer_year(c, fixed=True)) == ["2021", "2021"]


def test_days(spark):
    names = ["a/day1.py", "a/Day 3/x.py", "a/d5/x.py", "a/day-12.py", "a/day_1_a.py", "a/day01a.py", "a/07.py", "a/day_3_b.py", "09/x.py", "a/day30.py", "a/99.py"]
    assert column(spark, names, paths.infer_day) == ["01", "03", "05", "12", "01", None, "07", "03", "09", None, None]


def test_text(spark):
    assert column(spark, ["  a \r\nb\t\r\n\r\n", "", None], text.clean_code) == ["a\nb", "", None]
    assert column(spark, ["x ```py\na = 1\n``` y", "```\nb\n```", "```python\n```", " c "], text.extract_code) == ["a = 1", "```\nb\n```", "", "c"]
    assert column(spark, ["Day 3", "d7", "123", "9"], text.normalise_day) == [" 3", "07", "123", "09"]
    assert column(spark, ["x", "", "==", "(", "_-", " foo"], text.informative) == [True, False, False, False, False, True]


@pytest.mark.parametrize(("code", "want"), [
    ("def f(a, *b, k=1, **c):\n    return a + k", "def v0(v1, *v3, v2=1, **v4):\n    return v1 + v2"),
    ("xs = [x * x for x in ys]", "v0 = [x * x for v1 in ys]"),
    ("for x in x: print(x)", "for v0 in v0:\n    print(v0)"),
    ("import os\ntry:\n    os.x\nexcept OSError as e:\n    print(e)", "import os\ntry:\n    os.x\nexcept OSError as v0:\n    print(v0)"),
    ("class A:\n    n = 1\n    def m(self): return self.n", "class v0:\n    v1 = 1\n\n    def v2(v3):\n        return v3.n"),
    ("with open(p) as (a, b): a += b", "with open(p) as (v0, v1):\n    v0 += v1"),
    ("f = lambda q: q", "v0 = lambda q: q"),
])
def test_rename(code, want):
    assert pycode.preprocess(code, identifiers=True) == want


def test_transforms():
    assert pycode.preprocess("x = 1  # c\n# full\ny = 2\n", comments=True) == "x = 1     \n      \ny = 2\n"
    assert pycode.preprocess('def f():\n    "d"\n', docstrings=True) == "def f():"
    assert pycode.preprocess("def f(", docstrings=True) is None
    assert pycode.preprocess(None, True) is None


def test_status():
    cases = {"": "empty", " \n": "empty", None: "empty", "x = (": "syntax", "import a": "no_meaningful", "import a\n'x'": "ok", "x\0": "syntax"}
    assert {k: pycode.code_status(k) for k in cases} == cases
    assert pycode.parse('"\\d"') is not None and pycode.parse('"\\d"', strict=True) is None


def test_features():
    f = dict(zip(pycode.AST_FEATURES, pycode.ast_features("x = 1"), strict=True))
    assert f["depth_per_child"] == 2.0 and pycode.ast_features("x = (") is None
    t = dict(zip(pycode.TOKEN_FEATURES, pycode.token_features("if x: y = 'a' + 1\n"), strict=True))
    assert t["identifier_ratio"] == pytest.approx(2 / 10) and t["keyword_ratio"] == pytest.approx(1 / 10)
    assert len(pycode.ast_features(ast.unparse(ast.parse("def f(): pass")))) == 18 and len(pycode.token_features("")) == 11


def test_group_mode():
    with pytest.raises(ValueError):
        text.group_id("other")


def test_sources_are_parsed_once(monkeypatch):
    """All settings and all facts of a source that reads without a warning cost one parse."""
    calls, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: calls.append(a) or parse(*a, **k))
    code = 'def f(value):\n    "doc"\n    return value  # note\n'
    got = pycode.preprocess_each(FEATURE_SETS).func(pd.Series([code]))
    assert len(calls) == 1 and got.iloc[0].tolist() == [pycode.preprocess(code, *s[1:]) for s in FEATURE_SETS]
    calls.clear()
    facts = pycode.code_features.func(pd.Series([code]))
    assert len(calls) == 1 and facts.loc[0, ["status", "strict"]].tolist() == ["ok", True]
    assert pycode.code_facts("status", "strict").func(pd.Series(["x = '\\d'", "def (", "import os", None])).values.tolist() == [["ok", False], ["syntax", False], ["no_meaningful", True], ["empty", False]]


@pytest.mark.parametrize("name", ["validate_status", "ast_features", "token_features", "strip_comments", "strip_docstrings", "rename_identifiers", "preprocess_matrix"])
def test_a_small_file_of_sources_is_parsed_on_all_cores(spark, name):
    rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(rows.select(F.spark_partition_id()).distinct().collect()) > 4
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("ArrowEvalPython") == 1
