from loomgraph.operators import wikitext as W

TEXT = """{{Infobox scientist
| name = Ann [[Example (person)|Example]]
| image = a.jpg
| birth_date = {{birth date|1879|3|14}}
| place = [[Ulm]], [[Kingdom of X|the Kingdom]]
| spouse = {{marriage|[[B]]|1903|1919}}
| known = {{plainlist|
* [[General relativity]]
* {{lang|de|Licht}}
}}
| awards = {{hlist|[[Prize]] (1921)|Medal|class=x}}
| empty =
}}
'''Ann''' was ''born''{{ndash}}there.<ref name="a">{{cite|t=1}} see [[Z]]</ref> [[File:p.jpg|thumb|with [[Nested]] link]]
== Life ==
Went to [[Zürich#Old town|Zürich]] and [[#Work|below]]. {{math|E}} <!-- hidden [[No]] --> {{lang|la|annus}}
=== Work ===
A [[Talk:X]] b [[broken
{{also broken
[[Category:Physicists]] [[Category:People|Example]]
"""


def test_article():
    a = W.article("Ann Example", TEXT, "https://x", 100_000)
    assert a["url"] == "https://x/wiki/Ann_Example"
    assert a["categories"] == ["Physicists", "People"]
    links = dict(a["links"])
    assert links["Zürich"] == "https://x/wiki/Z%C3%BCrich" and links["below"] == "https://x/wiki/Ann_Example"
    assert links["Nested"] == "https://x/wiki/Nested" and "No" not in links and "Talk:X" not in links
    box = dict(a["infobox"])
    assert box["name"] == "Ann Example" and box["place"] == "Ulm, the Kingdom" and "image" not in box and "empty" not in box and "spouse" not in box
    rest = a["content"]
    assert rest.startswith("=== Infobox: scientist ===\n\n**name**: Ann [Example](/wiki/Example_%28person%29)\n")
    assert "**birth_date**: 14 March 1879\n" in rest and "spouse" not in rest
    assert "**known**: [General relativity](/wiki/General_relativity) * Licht\n" in rest
    assert "**awards**: [Prize](/wiki/Prize) (1921), Medal\n" in rest
    assert "**Ann** was *born*–there.\n\n== Life ==\n\nWent to [Zürich](/wiki/Z%C3%BCrich) and [below](#Work). $E$ la\n\n=== Work ===\n\nA b [[broken" in rest


def test_markdown_edges():
    assert W.markdown("") == "" and W.article("", "", "", 10)["content"] == ""
    assert W.markdown("== A ==\n=== B ===\nbody") == "== A ==\n\n=== B ===\n\nbody"
    assert W.markdown("a | b }} ]] c") == "a | b }} ]] c"
    deep = "[[" * 5000 + "x" + "]]" * 5000
    assert "x" in W.markdown(deep)
    assert W.markdown("{{" * 3000) == "{{" * 3000
    assert W.article("T", "x" * 50, "", 10)["content"] == "x" * 10
    assert W.month("0") == "" and W.month("13") == "13"


def test_articles(spark):
    rows = spark.createDataFrame([(1, "T", "see [[A]]", 1), (2, None, None, 2), (3, "T", "see [[A]]", 3)], "id long, title string, text string, key int")
    got = {r.key: r for r in W.articles(rows, "id", "title", "text").collect()}
    assert got[1].content == got[3].content == "see [A](/wiki/A)" and got[1].links == {"A": "https://en.wikipedia.org/wiki/A"}
    assert got[2].content == "" and got[2].links == {} and got[2].categories == []
    assert W.articles(rows.limit(0), "id", "title", "text").count() == 0
