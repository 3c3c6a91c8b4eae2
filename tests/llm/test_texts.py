"""Main text, chats and benchmark leaks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corkscan import storage
from corkscan.llm import chat, html_text, templates
from corkscan.llm.registry import TRICKY_TEXT

# --- main text ---------------------------------------------------------------


def text_of(spark, rows):
    pages = spark.createDataFrame([(n, url, page, "clash") for n, (url, page) in enumerate(rows)], "page_id BIGINT, url STRING, html STRING, text STRING")
    return {r.page_id: r.text for r in html_text.extract(pages).collect()}


def test_article_without_side_matter(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
      <nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <article>no</article> --><div class="ad">Buy</div>
      <article class="post"><h1>Head &amp; line</h1><p><b>One<br><p>two &lt;b&gt;&nbsp; th<i>re</i>e
      <div class="share-buttons">Share</div><form>Mail <input value="x"></form><aside>Side</aside>
      <p title="a > b">four</p><ul><li>five<li>six</ul><section id="comments"><article>no</article></section></article>
      <footer>&copy; x</footer></body></html>"""
    found = text_of(spark, [("http://a.org/1", page), ("http://a.org/2", None), ("http://a.org/3", ""), (None, "<article>x &am y &#65;</article>"),
                            ("http://a.org/4", "<p>broken <b <article>z"), ("http://a.org/5", "<article>" + "w " * 50_000 + "</article>")])
    assert found[0] == "Head & line One two <b> three four five six"
    assert found[1] == found[2] == "" and found[3] == "x &am y A"
    assert found[5] == " ".join(["w"] * 50_000)


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark, monkeypatch):
    line = "this very line stands on every page of the host"
    own = lambda n: " ".join(f"own{n}word{k}" for k in range(8))
    page = lambda n: f"<div>{own(n)}</div><div>{line}</div><article>body {n} {line}</article>"
    rows = [("http://a.org/x", page(n)) for n in range(40)] + [("http://b.org/x", page(99))]
    expected = {n: f"{own(n)} body {n} {line}" for n in range(40)}
    found = text_of(spark, rows)
    assert {n: found[n] for n in range(40)} == expected
    assert found[40] == f"{own(99)} {line} body 99 {line}"  # the only page of its host
    monkeypatch.setattr(html_text, "CHUNK", 1)  # nearly each page in a group of its own
    assert text_of(spark, rows) == found


def test_copies_of_a_page_keep_their_text(spark):
    page = "<div>a page of plain text without any article of more than six words</div>"
    rows = [("http://a.org/x", page), ("http://a.org/x", page), ("http://a.org/y", page), ("http://a.org/z", page + "<p>and another end</p>")]
    found = text_of(spark, rows[:3])
    assert set(found.values()) == {"a page of plain text without any article of more than six words"}
    assert list(text_of(spark, rows).values()) == ["", "", "", "and another end"]  # the last one is a page of its own


def test_repeated_runs_equal_those_of_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    hosts = {}
    for n in range(40):
        blocks = [[draw.choice("abc") for _ in range(draw.randint(1, 14))] for _ in range(draw.randint(0, 4))]
        hosts.setdefault(f"h{n % 3}.org", []).append((n, blocks))
    hosts["h0.org"].append((40, hosts["h0.org"][0][1]))  # a copy

    expected = {}
    for pages in hosts.values():
        streams = {n: tuple(token for block in blocks for token in block) for n, blocks in pages}
        layouts = {n: str(blocks) for n, blocks in pages}
        runs = lambda stream: {stream[at : at + length] for length in range(html_text.RUN, 30) for at in range(len(stream) - length + 1)}
        every = {n: runs(stream) for n, stream in streams.items()}
        for n, blocks in pages:
            others = set().union(*(every[m] for m in every if layouts[m] != layouts[n]))
            stream, covered = streams[n], set()
            for run in every[n] & others:
                covered |= {at + k for at in range(len(stream) - len(run) + 1) if stream[at : at + len(run)] == run for k in range(len(run))}
            expected[n] = " ".join(token for at, token in enumerate(stream) if at not in covered)

    rows = sorted((n, host, "".join(f"<div>{' '.join(block)}</div>" for block in blocks)) for host, pages in hosts.items() for n, blocks in pages)
    rows = [(f"http://{host}/{n}", page) for n, host, page in rows]
    assert len(set(expected.values())) > 5 and text_of(spark, rows) == expected
    monkeypatch.setattr(html_text, "CHUNK", 2)
    monkeypatch.setattr(html_text, "FEW_PAGES", 0)
    assert text_of(spark, rows) == expected


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0


# --- chats -------------------------------------------------------------------

EVENTS = "conv_id BIGINT, seq BIGINT, kind STRING, message STRING, role STRING, text STRING"


def messages(spark, rows):
    found = chat.final_messages(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "at").collect()
    return [(r.conv_id, r.role, r.text) for r in found]


def test_events_are_folded(spark):
    rows = [
        (1, 1, "message", "u1", "user", "hi"), (1, 2, "message", "a1", "assistant", ""), (1, 3, "delta", "a1", "assistant", "He"),
        (1, 4, "delta", "a1", "assistant", "llo"), (1, 5, "message", "u2", "user", "more"), (1, 6, "message", "a2", "assistant", "old"),
        (1, 7, "regenerate", "a2", "assistant", "new"), (1, 8, "delta", "a2", "assistant", "!"), (1, 9, "edit", "u1", "user", "hey"),
        (2, 1, "message", "u1", "user", "q"), (2, 2, "message", "a1", "assistant", "one"), (2, 3, "message", "u2", "user", "two"),
        (2, 4, "regenerate", "a1", "assistant", "uno"), (2, 5, "message", "u3", "user", "three"),
        (3, 1, "delta", "x", "assistant", "begun by a delta"), (4, 1, None, None, None, None), (4, 1, None, None, None, None)]
    assert messages(spark, rows) == [
        (1, "user", "hey"), (1, "assistant", "Hello"), (1, "user", "more"), (1, "assistant", "new!"),
        (2, "user", "q"), (2, "assistant", "uno"), (2, "user", "three"), (3, "assistant", "begun by a delta"), (4, "", ""), (4, "", "")]
    assert messages(spark, []) == []


def test_formatted_conversations_read_back(spark):
    texts = [TRICKY_TEXT, "", "\\", "\\\\", "#", "####\\###", "</turn>", "</turn>\n### user:\n", "\\h\\t\\n\\\\h", "x:\n y", "é😀###", "a" * 100_000, "##", "</tur", "n>"]
    rows = [(1, n, "message", None, "assistant" if n % 2 else "us:er\n### ", text) for n, text in enumerate(texts)]
    formatted = chat.render(chat.final_messages(spark.createDataFrame(rows, EVENTS)))
    back = formatted.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert [(t.role, t.text) for t in back.turns] == [(r[4], r[5]) for r in rows]
    assert back.loss == "".join(texts[1::2])


# --- leaks -------------------------------------------------------------------

ITEM = "Alice bought 5 kg of red apples for 12 euros from Mr Smith. Then Alice sold 5 kg. The end of the tale is here"


def leaks(spark, docs, items):
    docs = spark.createDataFrame([(n, text, "clash") for n, text in docs], "doc_id BIGINT, text STRING, item_id STRING")
    items = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    return {(r.doc_id, r.item_id): r.same_values for r in templates.find_leaks(docs, items).collect()}


def test_items_are_found_with_other_values(spark, monkeypatch):
    docs = [
        (1, f"Some words before. {ITEM} and after."),
        (2, "So " + ITEM.replace("5", "7").replace("12 euros", "99 dollars").replace("Smith", "Jones").replace("Alice", "Bob") + " so on"),
        (3, "Hm. " + ITEM.replace("bought 5", "bought 7")),  # one 5 became 7, the other stayed
        (4, ITEM[:40]), (5, None), (6, ""), (7, "other words " * 20_000 + ITEM), (8, ITEM.lower()), (1, f"Some words before. {ITEM} and after."),
        (9, ITEM + " " + ITEM.replace("5", "8"))]
    items = [(10, ITEM), (11, "too short"), (12, None), (10, ITEM), (13, "1 2 3 4 5 6 7 8 9")]
    found = leaks(spark, docs, items)
    assert {doc for doc, item in found if item == 10} >= {1, 2, 7, 9} and {item for _, item in found} == {10}
    assert {doc for doc, _ in found} <= {1, 2, 7, 8, 9}
    assert found[1, 10] and found[7, 10] and not found[2, 10]
    monkeypatch.setattr(templates, "FEW_WINDOWS", 0)
    assert leaks(spark, docs, items) == found


@pytest.mark.parametrize("few", [0, 100_000])
def test_rows_that_grow_with_the_documents_are_broadcast_by_their_number(spark, monkeypatch, few):
    """Stored, the windows that were found take less than a byte each: their files do not tell whether they fit the driver."""
    plans, store = {}, templates.materialise

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return store(df, name)

    monkeypatch.setattr(templates, "materialise", stored)
    monkeypatch.setattr(storage, "FEW_ROWS", few, raising=False)
    docs = [(n, f"{n} words before. {ITEM} and after.") for n in range(20)] + [(30, "no apples at all")]
    rows = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, "1 2 3 4 5 6 7 8 9")], "item_id BIGINT, text STRING")
    found = templates.find_leaks(rows, items)
    assert {r.doc_id for r in found.collect() if r.item_id == 10} == set(range(20))
    # Values are looked for around every window: of these two sides, the benchmark's is the one to be broadcast.
    joined = re.search(r"(\w+)Join \[item#\d+L, reading#\d+, item_at.*", found._jdf.queryExecution().sparkPlan().toString())
    assert joined[1] == ("BroadcastHash" if few else "SortMerge") and ("BuildRight" in joined[0]) == (few > 0)
    assert "BroadcastHashJoin" not in plans["aligned"] and "SortMergeJoin" in plans["aligned"]
    assert ("BroadcastHashJoin" in plans["covered-windows"]) == (few > 0)


def test_leaks_of_empty_tables(spark):
    assert leaks(spark, [], [(1, ITEM)]) == {} == leaks(spark, [(1, ITEM)], [])


def test_leaks_equal_a_plain_search(spark):
    import re

    from tests.conftest import SMALL

    docs, items = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    plain = lambda text: " ".join(re.findall(r"[^\W\d_]+|\d+", (text or "").lower()))
    asked = {r.item_id: plain(r.text) for r in items.collect()}
    expected = {(r.doc_id, item) for r in docs.collect() for item, text in asked.items() if text in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, items).collect()} == expected


def test_sentences_of_one_pattern_do_not_meet_each_other(spark):
    days = ["Monday", "Tuesday", "Friday", "Sunday"]
    sold = lambda name, first: " ".join(
        f"On {day} {name} sold {first + 3 * n} apples and earned {first + 3 * n + 18} dollars." for n, day in enumerate(days))
    item = sold("Anna", 12)
    docs = [(1, f"Some words before. {item} And after."), (2, sold("Bert", 31)),
            (3, sold("Anna", 99) + " " + item), (4, item.replace(" On Tuesday", " So it is said. On Tuesday")),
            (5, item.replace("On Tuesday Anna", "On Tuesday Bert")), (6, " ".join(item.split(". ")[:2]))]
    found = leaks(spark, docs, [(10, item)])
    assert {doc for doc, _ in found} == {1, 2, 3, 4} and found[1, 10] and found[3, 10] and not found[2, 10]


def test_values_of_other_lengths_and_copies_in_other_cases_are_found(spark):
    item = ("A farmer has 40 hens and sells 15 of them to his neighbour Smith before the rain comes. "
            "How many hens does the farmer still have when neighbour Smith gives 15 back to the farmer")
    names = "In the morning the boy Tom walks with the girl Ann to school and at noon both of them walk home again by the river"
    docs = [(1, item.replace("40", "1,037.5").replace("15", "12.5")), (2, item.replace("Smith", "Mary Jones")),
            (3, "so " + ITEM.lower()), (4, ITEM.upper()), (5, ITEM.title()), (6, item.replace("15", "12.5", 1)),
            (7, names.replace("Tom", "John Lee").replace("Ann", "Mary  Ann Ray")), (8, item.replace("Smith", "Mary Jones", 1))]
    found = leaks(spark, docs, [(10, ITEM), (20, item), (30, names)])
    assert set(found) == {(1, 20), (2, 20), (3, 10), (4, 10), (5, 10), (7, 30)}
    assert found[3, 10] and found[4, 10] and found[5, 10] and not found[1, 20] and not found[2, 20]


def test_items_without_windows_are_found_as_a_whole(spark):
    items = [(1, "12 + 30 * 7 = 222"), (2, "Who wrote Faust?"), (3, "Anna Bert Carl Dora Emil"), (4, "1 2 3 4 5 6 7 8 9"),
             (5, "北京是中国的首都,人口最多的城市是哪一个"), (6, "days in five weeks of work"), (7, "!"), (8, "首都")]
    docs = [(1, "We know that 12 + 30 * 7 = 222 holds. " * 2), (2, "he asked: who wrote faust? " + "and more " * 5), (3, "So Anna, Bert, Carl, Dora, Emil came."),
            (4, "0 1 2 3 4 5 6 7 8 9 10"), (5, "我知道北京是中国的首都,人口最多的城市是哪一个吗"), (6, "after 35 days in five weeks of work"),
            (7, "12 + 30 * 7 = 223"), (8, "1 2 3 4 5 6 7 8"), (9, "who wrote"), (10, "!"), (11, "")]
    found = leaks(spark, docs, items)
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 8), (6, 6)} and all(found.values())


def test_short_items_are_no_evidence_among_other_words(spark):
    items = [(1, "Yes"), (2, "42"), (3, "who wrote faust")]
    docs = [(1, "Yes, there were 42 of them"), (2, "42."), (3, "Who wrote Faust?"), (4, "tell me who wrote Faust or else"), (5, "no")]
    docs, items = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = {(r.doc_id, r.item_id): r.evidence for r in templates.find_leaks(docs, items).collect()}
    assert found == {(1, 1): False, (1, 2): False, (2, 2): True, (3, 3): True, (4, 3): False}


def test_texts_without_a_clue_hold_nothing(spark, monkeypatch):
    """Random texts and damaged items: the same is found with every text read in full."""
    rng = random.Random(12)
    words = ["apple", "Bert", "tree", "of", "12", "3.5", "kg", "Anna", "river", "the", "Tokyo東京", "北", "京", "walks", "Mary Ann", "x"]
    items = [(n, " ".join(rng.choices(words, k=rng.choice([1, 3, 6, 12, 40])))) for n in range(60)]
    docs = []
    for n in range(300):
        text = rng.choices(words, k=rng.randrange(30))
        part = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            part[rng.randrange(len(part))] = rng.choice(words)
        at = rng.randrange(len(text) + 1)
        docs.append((n, " ".join([*text[:at], *part, *text[at:]]).replace("x ", rng.choice(["x. ", "x "]))))
    docs, items = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = sorted(map(tuple, templates.find_leaks(docs, items).collect()))
    monkeypatch.setattr(templates, "_may_leak", lambda texts, *_: texts)
    assert found == sorted(map(tuple, templates.find_leaks(docs, items).collect())) and len(found) > 100


def test_articles_inside_a_layout_with_side_words_are_content(spark):
    inside = "<p>crumbs</p><article><h1>Head</h1><p>body</p><div class='share'>no</div></article><p>more</p>"
    wraps = ["<div class='has-sidebar'>{}</div>", "<div class='content-with-sidebar'><div>{}</div></div>", "<section id='search-results'>{}</section>",
             "<main><div class='widget-area layout'>{}</div></main>", "<div class='has-sidebar'><main>{}</main></div>"]
    dropped = ["<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", "<div class='comments'>{}</div>",
               "<div class='has-sidebar'><div id='comments'>{}</div></div>", "<div role='navigation'>{}</div>", "<div class='related'>{}</div>"]
    found = text_of(spark, [(f"http://{n}.org/x", wrap.format(inside)) for n, wrap in enumerate(wraps + dropped)])
    assert [found[n] for n in range(len(wraps + dropped))] == ["Head body"] * 4 + ["crumbs Head body more"] + [""] * len(dropped)
