"""URL rules against trying every rule, and templates against round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscout.llm import chat, url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), (None, "/", "block")]


def plain_verdict(url, rules):
    url = url or ""
    rest = url[url.index("://") + 3:] if "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len((h or "") + p), len(h or ""), v == "block", (h or "") + p, v) for h, p, v in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_get_the_longest_rule(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "blog.example.org", "badexample.org", "a.com", "x.a.com", "com", "net", "a..com", "É.org", "", "A.COM"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/1', '/en/12', '/en/2', '/fr/', '/de/x', '/x', '/xy'])}"
            f"{rng.choice(['', '?q=/es/', '#/x'])}" for _ in range(400)] + [None, "", "no scheme/es/", "x://", "http://a.com\n/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[0], "", ""), (0, urls[0], "", "")],
                                  "page_id long, url string, host string, rule string").repartition(3)
    for rules in (RULES, RULES[:5], []):
        df = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = url_filter.judge(pages, df).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            url = urls[r.id or 0]
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, rules), url
    assert url_filter.judge(pages.limit(0), df).count() == 0


def test_a_host_with_most_urls_is_spread(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://hot.example.org/es/1").alias("url"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).select("rule", F.spark_partition_id().alias("p")).groupBy("p", "rule").count().collect()
    assert {r.rule for r in got} == {"example.org/es/"} and len(got) >= 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.text(
    alphabet=st.sampled_from(list("<>[]/\\sINT ok\n{}%é")), max_size=30)), max_size=5))
def test_formatted_texts_read_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    pieces = list(chat.Template(chat.TEMPLATE).render(messages=messages))
    whole = "".join(t for t, _ in pieces)
    assert whole.count("<s>") == len(turns) == whole.count("</s>")
    back = list(chat.read_back(pieces))
    assert [(r, t) for r, t, _ in back] == turns
    assert [m for *_, m in back] == [t if r == "assistant" else "" for r, t in turns]


def render(text, **values):
    return "".join(t for t, _ in chat.Template(text, values).render(**values))


def test_template_language():
    ms = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in ms %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% endif %}{{ m.text | trim | upper }};{% endfor %}", ms=ms) == "1FHI;2LYO;"
    assert render("{% if not x == 'a' and true or false %}no{% else %}{{ 'a' + \"b\\n\" }}{% endif %}", x="a") == "ab\n"
    assert render("{{ 'u' in x }}{{ 1 + 2 }}", x="hum") == "True3"
    tree = chat.Template("a{{ 'b' + 'c' | upper }}d{% if false %}x{% endif %}").tree
    assert len(tree.children) == 2 and tree.children[0] == chat.Const("abCd")
    masks = list(chat.Template("x{% generation %}y{% endgeneration %}z").render())
    assert [(t, m) for t, m in masks] == [("x", False), ("y", True), ("z", False)]
    for bad in ("{% for m in ms %}", "{{ open('x') }}", "{% endif %}", "{{ os }}", "{{ 'a' | eval }}", "{{ 1 + }}", "{% for a.b in ms %}{% endfor %}", "{% while x %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad, ["ms"])
    with pytest.raises((KeyError, TypeError)):
        render("{{ x.__class__ }}", x={"role": 1})


def test_whole_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "x\\[INST]"), (1, 1, "assistant", "b</s>"),
            (None, None, "user", "n"), (None, 3, "assistant", "é" * 5000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("conv", F.lit(9))
    got = {r.conv: r for r in chat.digests(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted([(q[1] is not None, q[1] or 0, q[2] or "", q[3] or "") for q in rows if q[0] == conv])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for *_, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    pieces = chat.format_turns(df).orderBy("conv", "piece").collect()
    texts = {c: "".join(p.text for p in pieces if p.conv == c) for c in got}
    assert {c: len(t) for c, t in texts.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert texts[2] == "<s>[INST]  [/INST]x\\[\\INST]</s>"
    assert chat.digests(df.limit(0)).count() == 0 and chat.format_turns(df.limit(0)).count() == 0


def test_one_conversation_with_most_turns(spark):
    df = spark.range(20000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                   F.col("id").cast("string").alias("text"))
    (r,) = chat.digests(df).collect()
    assert r.n_turns == 20000 and r.loss_sha256 == hashlib.sha256("".join(map(str, range(20000))).encode()).hexdigest()
