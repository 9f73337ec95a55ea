from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import fim

TEXTS = [None, "", "one line", "\n", "\n\n", "a\nb\n", "a\nb", "x <P> y\nz", "<S>", "t\n<M>", "<\n<S\nP>\n<P", "é\r\n\U0001f600\n end", "\n".join(f"line {i}" for i in range(5000)), "w" * 300_000, "a\nb\n", "[^\n]+|$1\\E\n(x)"]


def plainly(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, _text string")
    done = fim.transform(df, **more)
    assert done.columns == ["doc_id", "text", "_text", "n", "form", "prefix", "middle", "suffix", "output"]
    got = done.withColumn("back", fim.restore(done["output"], done["form"])).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], r[1], *plainly(r[0], r[1], **more)) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"], *(r[c] for c in ("n", "form", "prefix", "middle", "suffix", "output"))) for r in got), key=repr) == want
    assert all(r["back"] == (r["text"] or "") and r["_text"] == "kept" for r in got)
    return {r["form"] for r in got}


def test_equals_plain_python(spark):
    rows = [(i * 31 + j, t, "clash", "kept") for i, t in enumerate(TEXTS) for j in range(6)]
    assert check(spark, [*rows, rows[7], (None, "a\nb\nc", "clash", "kept"), (None, None, "clash", "kept")]) == {"plain", "psm", "spm"}
    check(spark, rows, rate=40, spm=10)
    check(spark, [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="<>PSM\n a", max_size=40), min_size=1, max_size=60))
def test_texts_like_sentinels(spark, texts):
    check(spark, [(i, t, "clash", "kept") for i, t in enumerate(texts)])


def test_units_that_lose_text_leave_it_plain(spark):
    df = spark.createDataFrame([(i, "a b  c") for i in range(8)], "doc_id long, text string")
    assert {r["output"] for r in fim.transform(df, unit=r"\w+").collect()} == {"a b  c"}
    words = fim.transform(df, unit=r"\S+\s*|\s+")
    assert {r[0] for r in words.select(fim.restore(words["output"], words["form"])).collect()} == {"a b  c"} and words.where("form <> 'plain'").count() == 8


def test_broken_outputs_are_null(spark):
    df = spark.createDataFrame([("<P>a<S>b", "psm"), ("a<P>b<S>c<M>d", "psm"), ("<S>b<P>a<M>c", "psm"), ("x", "other"), ("<P><S><M>", "psm")], "output string, form string")
    assert [r[0] for r in df.select(fim.restore(df["output"], df["form"])).collect()] == [None, None, None, None, ""]


def test_sentinels_that_may_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P", "<S>", "<M>"), ("<<P>", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.Sentinels(*marks)
