"""op13 against the contract's own patterns, and disguises of planted data against where they were planted."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratavox.llm import pii, registry

# The patterns of the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        (EMAIL, lambda m: True),
        (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, (pattern, keep) in enumerate(rules) for m in re.finditer(pattern, text) if keep(m)]


def test_plain_spans_equal_the_patterns():
    rnd = random.Random(4)
    for letters in ("a@.b_", "0123.", "01 -4", "+1 ().-2", "a@.1+ -é٣(", "4- 1"):
        for _ in range(1500):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
            assert pii.plain(text) == brute(text), text
    for text in ["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.004", "256.1.1.1", "a@b.c_d@e.f", "a@b.c@d.e", "x@a..b", "0" * 16, "1.2.3." + "0" * 5000 + "7"]:
        assert pii.plain(text) == (brute(text) if len(text) < 4000 else [(1, 0, len(text))]), text


DISGUISED = [
    ("email", "john.doe [at] example dot com"),
    ("email", "john dot doe at example dot co dot uk"),
    ("email", "joe(at)mail(dot)org"),
    ("email", "jane { AT } mail [.] example.org"),
    ("email", "j&#64;x&#46;de"),
    ("email", "jo @ example.com"),
    ("email", "maria arroba correo punto es"),
    ("email", "hans ät post punkt de"),
    ("email", "user_at_host_dot_org"),
    ("email", "аnn@ехаmple.com"),
    ("email", "ann＠example．com"),
    ("email", "ann​@exam­ple.com"),
    ("phone", "plus four nine one seven zero one two three four"),
    ("phone", "＋４９ 170 1234567"),
    ("phone", "+49 170–1234567"),
    ("phone", "plus one double five five 123 4567"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "１０.0.0.1"),
    ("ip", "1O.0.0.l2"),
    ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "4111 1111 1111 lll1"),
    ("card", "vier eins eins eins, eins eins eins eins, eins eins eins eins, eins eins eins eins"),
    ("card", "4111‑1111‑1111‑1111"),
]


@pytest.mark.parametrize(("kind", "value"), DISGUISED)
def test_disguises_map_back_to_their_source(kind, value):
    for before, after in (("", ""), ("Ünï é​ write: ", ", please 🙂."), ("plain@mail.com or\n", "\n+1 555 123 4567 too")):
        text = before + value + after
        found = pii.find(text)
        assert (pii.KINDS.index(kind), len(before), len(before) + len(value), True) in found, found
        assert [s[:3] for s in found if not s[3]] == brute(text)
        assert sum(s[3] for s in found) == 1


@pytest.mark.parametrize(
    "text",
    ["look at example.com and meet me at noon dot", "meet at this point we go", "at one point two people came", "one two three four five six", "10–20–30–40", "the dot at the end", "Ñandú ½ ² … «œuvre»", "+1 (555) 123-4567 one day", "a (at) b", "f(x) = [0.5] <b>", "привет от ехо", ""],
)
def test_clean_texts_stay_clean(text):
    assert not [s for s in pii.find(text) if s[3]]


def test_every_character_keeps_its_source():
    rnd = random.Random(9)
    for _ in range(300):
        source = "".join(rnd.choice(["a", "b", "X", "Y"]) for _ in range(rnd.randrange(1, 30)))
        now, cells = pii.Rewritten(source), [(c, i, i + 1) for i, c in enumerate(source)]
        for _ in range(3):
            edits, i = [], 0
            while i < len(cells):
                n = rnd.randrange(1, 4)
                if rnd.random() < 0.3:
                    edits.append((i, min(i + n, len(cells)), rnd.choice(["", "q", "rst"])))
                i += n
            after, pos = [], 0
            for a, b, out in edits:
                after += cells[pos:a] + [(c, cells[a][1], cells[b - 1][2]) for c in out]
                pos = b
            cells = after + cells[pos:]
            now.edit(edits)
            assert now.text == "".join(c for c, _, _ in cells)
        for a in range(len(cells)):
            for b in range(a + 1, len(cells) + 1):
                assert now.source(a, b) == (cells[a][1], cells[b - 1][2])


def test_time_is_linear_in_long_texts():
    for text in ["a" * 1000, "1" * 1000, "1." * 500, "a@" * 500, "@a" * 500, "one " * 250, "a dot " * 200, "a at b dot c " * 80, "​a" * 500, "(" * 1000, "4 " * 500, "+1" * 500, "а" * 1000]:
        began = time.time()
        pii.find(text * 400)
        assert time.time() - began < 8, text[:12]


def test_query_on_a_small_table(spark, tmp_path):
    texts = [None, "", "x", "a@b.co +1 555 123 4567", "a@b.co +1 555 123 4567", "joe(at)mail(dot)org 1.2.3.4", "é" * 3000 + " 4111 1111 1111 1111", "🙂 a@b.co"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a@b.co", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, added string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op13_pii"](spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    got = {r.doc_id: r for r in found.collect()}
    for i, t, *_ in rows:
        base = brute(t or "")
        said = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        assert got[i].spans == said(pii.find(t or ""))
    assert got[5].spans == "email:0:19,ip:20:27"


def test_other_columns_stay_and_redaction_leaves_the_rest(spark):
    texts = [None, "", "write a@b.co, or joe (at) mail.org!", "🙂 +1 555 123 4567."]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int").withColumn("kind", F.lit(1))
    scanned = pii.scan(df)
    assert scanned.columns == ["doc_id", "text", "kind", "spans"]
    assert [r.text for r in pii.redact(scanned).orderBy("doc_id").collect()] == [None, "", "write [EMAIL], or [EMAIL]!", "🙂 [PHONE]."]
    assert pii.scan(df.where("false")).count() == 0
