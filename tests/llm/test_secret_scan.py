import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from prefboard.llm import queries, secret_scan

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def plainly(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def base(text):
    return [s for s in secret_scan.find_spans(text.encode()) if s[0] in ("assign", "access", "hex")]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_plain_patterns(seed):
    random.seed(seed)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "abcdef", "é", "ſecret", "toKen", "漢"]
    parts += ["AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef", "F" * 30, "a" * 24, "b" * 23, "x", "-", "\n", "==abcdef", "=a.b/c+d"]
    text = "".join(random.choices(parts, k=random.randint(0, 60)))
    assert base(text) == plainly(text)


def base62(number, length=6):
    out = ""
    for _ in range(length):
        number, digit = divmod(number, 62)
        out = secret_scan._BASE62.decode()[digit] + out
    return out


def base58check(raw):
    number = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big")
    out = ""
    while number:
        number, digit = divmod(number, 58)
        out = secret_scan._BASE58.decode()[digit] + out
    return out


def test_checksums_decide():
    body = "a1B2c3" * 5
    good = "ghp_" + body + base62(zlib.crc32(body.encode()))
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secret_scan.find_spans(f"x {good} y {bad}".encode()) == [("github", 2, 42)]
    assert secret_scan.find_spans(("npm_" + good[4:]).encode())[0][0] == "npm"
    key = base58check(bytes.fromhex("0488ADE4") + bytes(range(74)))
    assert key.startswith("xprv") and len(key) == 111
    assert secret_scan.find_spans(key.encode()) == [("xprv", 0, 111)]
    assert secret_scan.find_spans((key[:-1] + ("1" if key[-1] != "1" else "2")).encode()) == []


def test_odd_rows_and_clashing_columns(odd, none, clashing):
    rows = secret_scan.scan_secrets(odd).collect()
    assert len(rows) == odd.count() and all(r["secrets"] == [] for r in rows)
    assert secret_scan.scan_secrets(none).count() == 0
    again = secret_scan.scan_secrets(clashing)
    assert again.columns.count("secrets") == 1 and again.count() == odd.count()


def test_redaction(spark, odd):
    rows = [(1, "é token=abcdef012345 x", 9), (2, "clean", 5), (3, None, None), (4, "password=" + "0a" * 15 + " " + "f" * 24, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact_secrets(df).collect()}
    assert got == {1: ("é <secret> x", 12), 2: ("clean", 5), 3: (None, None), 4: ("<secret> <secret>", 17)}
    assert sorted(map(str, secret_scan.redact_secrets(odd).collect())) == sorted(map(str, odd.collect()))


def test_query_on_whole_table(spark, folder):
    rows = queries.QUERIES["op1_secret_scan"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and any(r["spans"] for r in rows)
    for r in rows:
        spans = plainly(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]


def test_no_shuffle(spark, folder):
    plan = secret_scan.scan_secrets(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", F.size("secrets"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
