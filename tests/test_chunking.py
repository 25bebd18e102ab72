"""Splitters on hand-written texts with known sections."""

from kbspark.operators import chunking as D


def test_markdown_paths():
    text = "intro\n# A\none\n\ntwo\n## B\nthree\n### C\nfour\n## D\n#### not split\n#no header\n# E"
    assert D.split_markdown(text) == ["intro", "# A\none  \ntwo", "## B\nthree", "### C\nfour", "## D\n#### not split\n#no header", "# E"]


def test_markdown_headers_alone_stay_with_the_deeper_one():
    assert D.split_markdown("# A\n## B\ntext\n# A\n## B\nmore") == ["# A  \n## B\ntext", "# A  \n## B\nmore"]
    assert D.split_markdown("# A\nx\n# A\ny") == ["# A\nx  \n# A\ny"]  # one path


def test_markdown_fences():
    text = "# A\n```\n# code\n\n## code\n```\nafter\n~~~\n# tilde\n~~~\n# B"
    assert D.split_markdown(text) == ["# A\n```\n# code\n\n## code\n```\nafter\n~~~\n# tilde\n~~~", "# B"]
    assert D.split_markdown("```x``` y\n# A\nb") == ["```x``` y", "# A\nb"]
    assert D.split_markdown("# A\n```\n# never closed") == ["# A\n```\n# never closed"]
    assert D.split_markdown("") == [] and D.split_markdown(" \n\n") == []


def test_html_blocks():
    text = "<html><head><title>t</title></head><body><p>zero</p><h1>One</h1><ul><li>alpha</li><li>beta <b>bold</b> end</li></ul><script>x()</script><h2>Two</h2><p>last<br>line</p></body></html>"
    assert D.split_html(text) == ["zero", "One", "alpha  \nbeta end  \nbold", "Two", "last line"]
    assert D.split_html("") == [] and D.split_html("plain & simple") == ["plain & simple"]
    assert D.split_html("<h1><b>x</b></h1>tail") == ["tail  \nx"]


def test_sections_and_secondary_chunks(spark):
    long = " ".join(f"w{i}" for i in range(900))
    rows = spark.createDataFrame([(1, f"<h1>H</h1><p>{long}</p><p>short</p>"), (2, None), (3, "")], "id int, t string")
    found = D.sections(rows, "id", "t", "html")
    assert [(r.id, r.section, r.content) for r in found.orderBy("id", "section").collect()] == [(1, 0, "H"), (1, 1, f"{long}  \nshort")]
    parts = D.secondary(found, "id").orderBy("section", "part").collect()
    assert (parts[0].section, parts[0].part, parts[0].content) == (0, 0, "H")
    assert [p.content for p in parts[1:]] == D.split_plain(f"{long}  \nshort") and len(parts) > 2 and all(D.estimate(p.content) <= D.SIZE for p in parts)
