from datetime import date

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.documents import adf_text, adf_to_text


def value(spark, f, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["a  B c\n", "", "  ", None, "x\x1cy", "word " * 50, "日本 語　"])
def test_words_and_tokens(spark, text):
    t = text or ""
    assert value(spark, T.words, text) == t.lower().split()
    assert value(spark, T.approx_tokens, text) == max(len(t.split()), len(t) // 4)


@pytest.mark.parametrize("text, expected", [
    ("<@U1> and <@U9>", "@Ann and @U9"), ("<mailto:a@b.c|a@b.c> <tel:+1|+1 2>", "a@b.c +1 2"), ("<#C1|general>", "#general"),
    ("<https://x.y|site> <https://z>", "site https://z"), ("ok :thumbs_up: at 10:30:45", "ok at 1045"), ("*bold* _it_ ~no~ a_b_c", "bold it no abc"), ("  a \t b ", "a b"), (None, None),
])
def test_chat_text(spark, text, expected):
    names = F.create_map(F.lit("U1"), F.lit("Ann"))
    assert value(spark, lambda c: T.chat_text(c, names), text) == expected


def test_html(spark):
    html = "<h1>T</h1><p>a<br/>b</p><ul><li>x</li></ul>&amp;lt;&nbsp;<script>s</script>\n\n\n\nend"
    assert value(spark, T.html_to_text, html) == "## T\n\na\nb- x< s\n\nend"


def test_adf(spark):
    tree = '{"content":[{"type":"heading","content":[{"type":"text","text":"H"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"one"},{"type":"hardBreak"}]}]}]},{"type":"codeBlock","content":[{"type":"text","text":"c"}]},{"type":"panel","content":[{"type":"text","text":"p"}]}]}'
    assert adf_text(tree) == "H\n- one\n\n```\nc\n```\np"
    assert adf_text(None) == adf_text("[") == adf_text("[]") == ""
    deep = '{"content":' * 200 + "[]" + "}" * 200
    assert adf_text(deep) == ""
    assert value(spark, adf_to_text, tree) == adf_text(tree)


@pytest.mark.parametrize("text, length, term, expected", [
    ("short", 10, "", "short"), ("a" * 30, 10, "", "a" * 10 + "..."), ("x" * 20 + "TERM" + "y" * 20, 12, "term", "..." + "xxxTERMyyyyy" + "..."), ("TERM" + "y" * 30, 8, "term", "TERMyyyy..."), ("a\nb ", 0, "", "a b"), ("z" * 20, 5, "none", "zzzzz..."),
])
def test_snippet(spark, text, length, term, expected):
    assert value(spark, lambda c: T.snippet(c, length, term), text) == expected


def test_dates():
    today = date(2026, 5, 10)
    assert T.parse_date("2026-05-10") == T.parse_date("20260510") == "2026-05-10"
    assert [T.parse_date(x, today) for x in ("1d", "2w", "3m", "1Y")] == ["2026-05-09", "2026-04-26", "2026-02-09", "2025-05-10"]
    with pytest.raises(ValueError):
        T.parse_date("soon")


def test_git_columns(spark):
    assert value(spark, T.pr_number, "Merged in a/b (pull request #12)") == 12 and value(spark, T.pr_number, "x") is None
    assert value(spark, T.merged_branch, "Merged in a/b (pull request #12)") == "a/b" and value(spark, T.merged_branch, "x") is None
    diff = "diff --git a/x.py b/x.py\n+1\ndiff --git a/y.lock b/y.lock\n+2\ndiff --git a/z.py b/z.py\n+3\n"
    assert value(spark, lambda c: T.filter_diff(c, [r"\.lock$"]), diff) == diff.replace("diff --git a/y.lock b/y.lock\n+2\n", "")
    assert value(spark, lambda c: T.filter_diff(c, []), diff) == diff and value(spark, lambda c: T.filter_diff(c, ["x"]), None) is None


def test_small_ones(spark):
    assert value(spark, T.record_id, "article:with:colon:1") == "article:with:colon" and value(spark, T.record_id, "plain") == "plain"
    assert value(spark, T.language, "a/b.tsx") == "typescript" and value(spark, T.language, "Makefile") == "unknown"
    assert value(spark, T.control_share, "\x01" + "a" * 9) == 0.1 and value(spark, T.control_share, "") == 1.0
    assert value(spark, T.epoch_date, "1715000000.000100") == "2024-05-06"
    assert value(spark, T.short_title, "t" * 90) == "t" * 77 + "..."
    assert value(spark, lambda c: T.user_label(c, F.lit("QA"), F.lit("U1")), "Ann") == "Ann (QA)" and value(spark, lambda c: T.user_label(c, F.lit(None), F.lit("U1")), None) == "U1"
    assert value(spark, T.links, "<https://a|x> <https://b>") == ["https://a", "https://b"]
