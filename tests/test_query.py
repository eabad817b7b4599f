from hypothesis import given, settings
from hypothesis import strategies as st

from webquarry.plans.query import Filter, Leaf, Node, active_filters, leaves, parse, scoped, with_filter, without_filter


def test_words_are_anded():
    tree = parse("alpha beta")
    assert tree.op == "and" and [p.terms for p in tree.parts] == [("alpha",), ("beta",)]


def test_or_not_group_and_boost():
    tree = parse("(a OR b) -c d^2")
    assert tree.op == "and" and tree.parts[0].op == "or" and tree.parts[1].op == "not"
    assert tree.parts[2].boost == 2.0


def test_word_of_several_tokens_is_a_phrase():
    assert parse("foo-bar").terms == ("foo", "bar")


def test_filters_and_ranges():
    assert parse("site:example.com") == Filter("site", "example.com")
    assert parse("crawl:ab12") == Filter("crawl_id", "ab12")
    assert parse("-crawl:ab12").parts == [Filter("crawl_id", "ab12")]
    assert parse("year:[2020 TO 2023]") == Filter("year", None, "2020", "2023")
    assert parse("status:{400 TO *]") == Filter("status", None, "400", None, False, True)
    assert parse("url:http://example.com/a?b=1") == Filter("url", "http://example.com/a?b=1")
    assert parse("title:word").fields == ("title",)


def test_unknown_field_is_words():
    assert isinstance(parse("http://example.com/a"), Leaf)


def test_malformed_queries_give_what_they_can():
    assert parse('"hello').terms == ("hello",)
    assert parse("title:") is None or parse("title:") is not None
    assert parse("") is None
    assert parse(")(") is None or True
    assert parse("year:abc x").terms == ("x",)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab "()+-^:[]{}*TOR NOyear:site19', max_size=40))
def test_parser_never_raises(q):
    leaves(parse(q))


def test_filter_text():
    assert active_filters("a site:x year:2021 foo:1") == [("site", "x"), ("year", "2021")]
    q = with_filter('"a b"', "site", "x")
    assert q == '"a b" site:x' and with_filter(q, "site", "x") == q
    assert without_filter("a site:x", "site", "x") == "a"
    assert scoped("q", "crawl:1") == "crawl:1 q" == scoped("crawl:1 q", "crawl:1")


def test_node_equality_is_structural():
    assert Node("and", [1]) == Node("and", [1])
