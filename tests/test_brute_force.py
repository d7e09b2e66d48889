"""Column rules against plain Python over many random texts."""

import ast
import ipaddress
import random
import re
from urllib.parse import urlsplit

import pytest

from sparkelt.functions import redaction
from sparkelt.functions.validation import FORBIDDEN_WORDS, METADATA_HOSTS, READ_STARTS, SCHEMES, classify_endpoint, classify_sql
from sparkelt.operators.conditions import safe_filter

PIECES = ["password", "PassWord", "passwd", "secret", "API_KEY", "token", "auth_token", "aws_secret", "secret_key", "bearer ",
          "Bearer ", "AKIA", "ASIA", "abia", "azure_storage_key", "AccountKey", "=", ":", " = ", " : ", "'", '"', "://", "@", "http",
          "pg+x", "u:p", "\n", " ", "  ", ",", ";", "/", ".", "-", "_", "1234567890", "ABCDEF0123456789", "a" * 20, "Zz9+/=" * 6,
          "é", "ß", "host", "x", "::", "\u00a0", "\u2003=",
          "\u017fecret", "ap\u0131_key", "to\u212aen", "AP\u0130_KEY", "bearer\u00a0"]


def random_texts(seed, pieces, count, longest):
    draw = random.Random(seed)
    return ["".join(draw.choices(pieces, k=draw.randint(0, longest))) for _ in range(count)]


@pytest.mark.parametrize("strict", [False, True])
def test_redaction(spark, strict):
    texts = random_texts(11, PIECES, 3000, 25)

    def plain(text):
        for pattern, replacement in redaction.STRICT if strict else redaction.PLAIN:
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), text)
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["t"] for r in redaction.redact_table(df, "t", strict).orderBy("i").collect()]
    want = list(map(plain, texts))
    assert got == want and sum(a != b for a, b in zip(texts, want)) > 500


URL_PIECES = ["http://", "HTTPS://", "s3a://", "jdbc:", "ftp://", "//", "user:pw@", "169.254.1.2", "169.254.169.254", "10.1.2.3",
              "224.0.0.9", "250.1.1.1", "127.0.0.1", "192.168.0.1", "172.20.1.1", "8.8.8.8", "metadata", "Instance-Data", "localhost", ":80",
              "/path", "?q=1", "#f", "example.com", "1.2.3", "300.1.1.1", "01.2.3.4", "@"]


def test_endpoints(spark):
    urls = random_texts(5, URL_PIECES, 4000, 5)
    urls += [f"http://[{a}]{p}" for a in ("::1", "fe80::9", "ff05::2", "2001:db8::1", "fd00:ec2::254", "fc00::1", "4000::1", "::")
             for p in ("", ":80/x")]

    def plain(url):
        if not url:
            return "allowed"
        parts = urlsplit(url)
        if parts.scheme not in SCHEMES:
            return "blocked_scheme"
        host = parts.hostname
        if not host:
            return "allowed"
        if host in METADATA_HOSTS:
            return "blocked_metadata"
        try:
            address = ipaddress.ip_address(host)
        except ValueError:
            return "allowed"
        if address.is_link_local:
            return "blocked_link_local"
        return "blocked_reserved" if address.is_multicast or address.is_reserved else "allowed"

    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    got = [r["verdict"] for r in classify_endpoint(df, "u").orderBy("i").collect()]
    want = list(map(plain, urls))
    assert [(u, g, w) for u, g, w in zip(urls, got, want) if g != w] == [] and len(set(want)) == 5


SQL_PIECES = ["SELECT ", "with x as ", "explain ", "drop", "DELETE ", " update", "created", "--", "\n", "/*", "*/", ";", " ", "'", "1", "from t",
              " grant ", "copy_x", "_exec", "EXEC ", "\u00a0", "dropé", "in\u017fert"]


def test_sql(spark):
    texts = random_texts(9, SQL_PIECES, 4000, 9)

    def plain(text):
        without = re.sub(r"/\*.*?\*/", "", re.sub("--[^\n]*", "", text), flags=re.S)
        filled = [part.strip().upper() for part in without.split(";") if part.strip()]
        return len(filled) == 1 and filled[0].startswith(READ_STARTS) and not set(FORBIDDEN_WORDS) & set(re.findall(r"\w+", filled[0]))

    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    got = [r["verdict"] == "ok" for r in classify_sql(df, "q").orderBy("i").collect()]
    want = list(map(plain, texts))
    assert got == want and 100 < sum(want) < 3900


def test_conditions(spark):
    """Random conditions over rows without nulls agree with Python's own evaluation."""
    draw = random.Random(3)
    data = [(i, draw.randint(-5, 5), draw.choice("abc"), draw.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(data, "i int, n int, s string, b boolean")

    def leaf():
        return draw.choice([
            lambda: f"n {draw.choice(['<', '<=', '>', '>=', '==', '!='])} {draw.randint(-5, 5)}",
            lambda: f"{draw.randint(-5, 0)} <= n < {draw.randint(0, 5)}",
            lambda: f"s {draw.choice(['in', 'not in'])} {draw.sample('abc', 2)}",
            lambda: f"s != '{draw.choice('abc')}'", lambda: "b", lambda: f"b == {draw.choice([True, False])}",
        ])()

    def condition(depth):
        if depth == 0:
            return leaf()
        parts = [condition(depth - 1) for _ in range(draw.randint(1, 3))]
        joined = f" {draw.choice(['and', 'or'])} ".join(f"({p})" for p in parts)
        return f"not ({joined})" if draw.random() < 0.3 else joined

    for _ in range(25):
        text = condition(draw.randint(0, 2))
        code = compile(ast.parse(text, mode="eval"), "condition", "eval")
        want = [i for i, n, s, b in data if eval(code, {"n": n, "s": s, "b": b})]
        assert sorted(r["i"] for r in safe_filter(df, text).collect()) == want, text
