"""Nested quotes, callouts and code of notes."""

from plumbline.operators import blocks as B

NOTE = """intro ^top
> [!info]- Main *title*
> text `inline` and ``a`b``
> > [!note]+ Inner
> > deep ^blk-1
> > ```py
> > > code [!x]
> > ````
> back ^main
> [!tip] Second

```
> [!no] code
~~~
```
>> jump
> [!odd kind] plain quote
    > four
~~~ sh
never closed
> still"""


def notes(spark, *texts):
    return spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, content string")


def test_blocks(spark):
    got = sorted(tuple(r)[1:] for r in B.blocks(notes(spark, NOTE)).collect())
    assert got == [
        (2, 9, 1, "info", True, "Main *title*", None, "main"),
        (4, 8, 2, "note", False, "Inner", 2, "blk-1"),
        (10, 10, 1, "tip", False, "Second", None, None),
        (16, 16, 2, "quote", False, "", 16, None),
        (16, 17, 1, "quote", False, "", None, None),
    ]
    assert B.blocks(notes(spark)).count() == 0 and B.blocks(notes(spark, None, "", "plain")).count() == 0
    assert [r["last"] for r in B.blocks(notes(spark, "> a\r\n> b\r\n")).collect()] == [2]


def test_lines_and_code(spark):
    by = {r.line: r for r in B.lines(notes(spark, NOTE)).collect()}
    assert [n for n, r in sorted(by.items()) if r.code] == [6, 7, 8, 12, 13, 14, 15, 19, 20, 21]
    assert (by[7].depth, by[7].text) == (2, "> code [!x]") and by[18].depth == 0
    out = {r.path: (r.text.split("\n"), r.unclosed) for r in B.without_code(notes(spark, NOTE, "a `b` c\n```\nx\n```", None)).collect()}
    text, unclosed = out["0.md"]
    assert unclosed == 19 and len(text) == 21 and text[2] == "> text  and " and text[6] == "" and text[18:] == ["", "", ""]
    assert out["1.md"] == (["a  c", "", "", ""], None) and out["2.md"] == ([""], None)


def test_depth_has_no_bound(spark):
    deep = "\n".join(">" * n + " x" for n in range(1, 400))
    got = B.blocks(notes(spark, deep)).collect()
    assert len(got) == 399 and {r.depth: r.line for r in got} == {n: n for n in range(1, 400)}
