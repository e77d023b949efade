from wayfare.operators import markdown as m


def links(text):
    return [(x.kind, x.dest, x.anchor, x.line) for x in m.scan(text).links]


def headings(text):
    return [(h.level, h.text, h.line) for h in m.scan(text).headings]


def test_frontmatter():
    s = m.scan("---\ntitle: 'A: b'\n# no: field\ntags: x, y\n\nbad line\n---\n# Head\ntext\n")
    assert s.title == "A: b" and s.frontmatter == [("title", "A: b"), ("tags", "x, y")] and s.body_line == 8
    assert m.scan("---\ntitle: open\n").frontmatter == []
    assert m.scan("---\na: 1\n...\nx").body_line == 4


def test_headings():
    assert headings("# A #\n\nB\n===\n\nC d\n---\n\n```\n# no\n```\n    # no\n####### no\n###### six") == [(1, "A", 1), (1, "B", 3), (2, "C d", 6), (6, "six", 14)]
    assert headings("# *em* `code` [l](x.md)") == [(1, "em code l", 1)]
    assert headings("> # quoted\n\n- # item") == [(1, "quoted", 1), (1, "item", 3)]


def test_sections_hold_their_children():
    text = "pre\n\n# A\n\n## B\n\n### C\n\n## D\n\n# E\n"
    s = m.scan(text)
    assert m.sections(s, text) == [(None, 0, 1, 2), ("A", 1, 3, 10), ("B", 2, 5, 8), ("C", 3, 7, 8), ("D", 2, 9, 10), ("E", 1, 11, 11)]
    assert m.sections(m.scan("\n\n# A"), "\n\n# A") == [("A", 1, 3, 3)]
    assert m.sections(m.scan(""), "") == []


def test_links():
    assert links("[a](x.md) ![i](i.png) [b *c*](<y z.md> 'T')") == [("markdown", "x.md", "a", 1), ("markdown", "y z.md", "b c", 1)]
    assert links("[a](x(1).md) \\[no](z.md) `[no](z.md)` [ref][r] [r]\n\n[r]: /u.md \"t\"") == [("markdown", "x(1).md", "a", 1), ("markdown", "/u.md", "ref", 1), ("markdown", "/u.md", "r", 1)]
    assert links("one\ntwo [a\nb](x.md)") == [("markdown", "x.md", "a b", 2)]
    assert links("<https://e.org/a.md> and [x [y](z.md)](w.md)") == [("markdown", "https://e.org/a.md", "https://e.org/a.md", 1), ("markdown", "z.md", "y", 1)]
    assert links("| a | b |\n|---|---|\n| [x](x.md) | [y](y.md) |") == [("markdown", "x.md", "x", 3), ("markdown", "y.md", "y", 3)]
    assert links("- [x](x.md)\n  1. [y](y.md)\n> [z](z.md)") == [("markdown", "x.md", "x", 1), ("markdown", "y.md", "y", 2), ("markdown", "z.md", "z", 3)]


def test_wikilinks():
    assert links("[[a]] [[b|see  b]] [[c#part]] [[ ]] [[d\ne]]") == [("wikilink", "a", "a", 1), ("wikilink", "b", "see b", 1), ("wikilink", "c#part", "c", 1), ("wikilink", "d e", "d e", 1)]
    assert links("`[[no]]` [[x <b>no</b> y]]") == []
    assert links("```\n[[fenced]]\n```") == [("wikilink", "fenced", "fenced", 2)]


def test_sentences():
    s = m.scan("First one. The [link](x.md) is here! Last [[w]] one.")
    assert [x.sentence for x in s.links] == ["The link is here!", "Last w one."]
    assert m.scan("v1.2 has [a](x.md).").links[0].sentence == "v1.2 has a."


def test_first_paragraph_skips_items_and_headings():
    assert m.scan("# H\n\n- item\n\nPara one\nmore.\n\nTwo").first_paragraph == "Para one more."
    assert m.scan("<div>\nx\n</div>\n\nText").first_paragraph == "Text"


def test_any_text_is_scanned():
    import random

    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("ab[]()`*_#>-|!<&\\\n \t~=.:1") for _ in range(rng.randrange(80)))
        m.sections(m.scan(text), text)
