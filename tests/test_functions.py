"""Addresses, messages, ids in JSON, archives."""

import json

import pytest
from pyspark.sql import functions as F

from lorewell.functions import messages, urls
from lorewell.operators import store


def column(spark, f, values):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v"))).orderBy("i").collect()]


def test_strict_urls(spark):
    good = {"HTTP://Ex.com": "http://ex.com", "https://a-b.c:0443/p?x=\\d#y": "https://a-b.c:443/p?x=\\d#y", "https://10.example.com/": "https://10.example.com/"}
    bad = ["https://a b.com", "https://evil\\@x.com", "https://u@x.com", "ftp://x.com", "https://1.2.3.4/", "https://x.0x7f", "https://x.com:0", "https://x.com:70000", "https://-x.com", "https://x.com.", "https://%61.com", "", None]
    assert column(spark, urls.strict_url, [*good, *bad]) == [*good.values(), *[None] * len(bad)]


@pytest.mark.parametrize(("host", "inside"), [("localhost", True), ("a.local", True), ("10.1.2.3", True), ("3232235777", True), ("0x7f000001", True), ("127.1", True), ("0177.0.0.1", True), ("100.64.0.9", True), ("8.8.8.8", False), ("10.example.com", False), ("localhost.com", False), ("[::1]", True), ("256.256.256.256", False), ("", False), (None, False), ("local", False), ("lan", True), ("x.home.arpa", True), ("[::ffff:10.0.0.1]", True), ("[fe80::1]", True), ("[2606:4700::1111]", False), ("[2001:db8::5]", True), ("169.254.7.7", True), ("172.32.0.1", False), ("0x8080808", False), ("09.1.1.1", False)])
def test_private_hosts(host, inside):
    assert urls.private(host) is inside


def test_messages(spark):
    rows = spark.createDataFrame([(1, "Hi <@U1> and <@U2|x>, see <https://a.b|this> <https://c> &lt;&amp;&gt; <#C1|room> <!here>"), (2, "plain"), (3, "<@U9>")], "id long, text string")
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bo")], "user string, name string")
    got = {r.id: r.text for r in messages.chat_text(rows, users).collect()}
    assert got == {1: "Hi @Ann and @Bo, see this https://c <&> #room @here", 2: "plain", 3: "@U9"}
    assert column(spark, messages.mail_body, ["CAUTION: This email originated from outside of the company.\nHello\n\n-- \nMe", "Yes\nOn Monday Bo wrote:\n> no", "a\nFrom: x\nb"]) == ["Hello", "Yes", "a"]
    assert column(spark, lambda c: messages.without_blocks(c, ["tool", "env"]), ["a<tool x=1>b\nc</tool>d<ENV>e</ENV>\n\n\n\nf"]) == ["ad\n\nf"]
    one = spark.sql("SELECT array(named_struct('text', 'a', 'quote', 'q'), named_struct('text', 'b', 'quote', 'r')) i, array('verbatim_exact', null) v")
    assert one.select(messages.stored_quotes(F.col("i"), F.col("v"))).first()[0] == [("a", "q"), ("b", None)]


def test_ids_in_json(spark):
    rows = spark.createDataFrame([(1, json.dumps({"a": ["x", "xx", {"x": 1}], "b": "see x"})), (2, "[1]"), (3, None)], "id long, j string")
    got = {r.id: r.j for r in messages.remapped(rows, "j", spark.createDataFrame([("x", "y")], "id string, survivor string")).collect()}
    assert json.loads(got[1]) == {"a": ["y", "xx", {"y": 1}], "b": "see x"} and got[2] == "[1]" and got[3] is None


def test_archive_then_delete(spark, tmp_path):
    rows, doomed = spark.range(10), spark.range(3)
    assert store.archive_then_delete(rows, doomed, "id", f"{tmp_path}/a").count() == 7 and spark.read.parquet(f"{tmp_path}/a").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        store.archive_then_delete(rows, doomed, "id", f"{tmp_path}/a")
