"""Operators 1, 2, 3, 7, 8, 9 and 10 against brute force, round trips and held-out accuracy."""

import datetime
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candela.llm import fingerprints, mixing, neighbours, packing, pseudonyms, quality, secrets

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s or "")


def test_fingerprints(docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, (d, x) in enumerate(rows):
        y = rows[(i + 1) % len(rows)][1]
        h = len(x) // 2
        edited = x[: len(x) - h] + y[:h]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(x), sha(edited))
        assert by_text.setdefault(x, r.fingerprint) == r.fingerprint
        a, b = ({p.split("@")[0] for p in f.split()} for f in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        places = [int(p.split("@")[1]) for p in r.fingerprint.split()]
        tokens = re.findall(fingerprints.TOKEN, x)
        assert places == sorted(places) and (not tokens or places)
        if len(tokens) > 11:  # no two chosen grams are further apart than a window
            assert all(q - p <= fingerprints.WINDOW for p, q in zip(places, places[1:]))
    assert fingerprints.edited_fingerprints(no_docs).collect() == []


def test_fingerprint_takes_rightmost(spark):
    d = spark.createDataFrame([("a b c d " * 9,)], "text string")
    f = fingerprints.with_fingerprint(d).first().fingerprint.split()
    hashes = {p.split("@")[0] for p in f}
    assert len(hashes) == 1  # one smallest gram, chosen again and again
    places = [int(p.split("@")[1]) for p in f]
    assert all(q - p == 4 for p, q in zip(places, places[1:]))


def plain_fingerprint(text):
    """The same grams by loops: Spark's xxhash64 chains XXH64 from seed 42."""
    tokens = re.findall(fingerprints.TOKEN, text)
    grams = []
    for i in range(max(1, len(tokens) - 3) if tokens else 0):
        h = 42
        for t in tokens[i : i + 4]:
            h = xxhash.xxh64_intdigest(t.encode(), h)
        grams.append(h >> fingerprints.PLACE + 1)
    out = []
    for i in range(max(1, len(grams) - 7) if grams else 0):
        w = grams[i : i + 8]
        k = i + max(j for j, g in enumerate(w) if g == min(w))
        if not out or out[-1] != k:
            out.append(k)
    return " ".join(f"{grams[k]:X}@{k}" for k in out)


def test_fingerprints_by_loops(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "déjà", "漢字仮名", "ไทย"]) for _ in range(n)) for n in (0, 1, 3, 4, 11, 12, 300)] + ["x" * 500, "".join(r.choice("abcdefghijk0123456789") for _ in range(400)), "a b c d " * 40, "漢" * 50]
    d = spark.createDataFrame([(i, t, 5, "v") for i, t in enumerate(texts)], "doc_id long, text string, r long, `a.b` string")
    out = fingerprints.with_fingerprint(d)
    assert {x.doc_id: x.fingerprint for x in out.collect()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)} and out.columns[:4] == d.columns


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x4E00 + 900))), "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_fingerprints_survive_a_shift(spark, alphabet):
    r = random.Random(4)
    run = "".join(r.choice(alphabet) for _ in range(600))
    d = spark.createDataFrame([(1, run), (2, "é" + run), (3, run[:300] + "é" + run[300:]), (1, "again"), (1, "again"), (None, run)], "doc_id long, text string")
    a, b, c = ({p.split("@")[0] for p in plain_fingerprint(t).split()} for t in (run, "é" + run, run[:300] + "é" + run[300:]))
    assert len(a & b) / len(a | b) > 0.9 and len(a & c) / len(a | c) > 0.8
    got = fingerprints.edited_fingerprints(d).collect()
    assert len(got) == 6 and {x.fingerprint for x in got if x.doc_id == 2} == {plain_fingerprint("é" + run)}


def test_pseudonyms(spark, no_docs):
    text = ("card 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112; a.b@c.org +1 (984) 555-5227 224.228.19.86, 999.1.1.1 "
            "on 2024-02-29 not 2023-02-29, 31.12.1999, 078-05-1120; again 4111111111111111")
    d = spark.createDataFrame([(1, text), (2, "x 224.228.19.86 y"), (3, None), (4, ""), (5, "clean 12 words")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.report(d).collect()}
    out = got[1].pseudonymised
    assert got[1].pii_kinds == "card,card,email,phone,ipv4,date,date,ssn,card"
    for gone in ("4111111111111111", "4111 1111 1111 1111", "a.b@c.org", "555-5227", "224.228.19.86", "2024-02-29", "31.12.1999", "078-05-1120"):
        assert gone not in out
    assert all(x in out for x in ("4111111111111112", "999.1.1.1", "2023-02-29"))
    cards = re.findall(r"\d{16}", out)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10
    assert cards[0] == cards[2] and luhn(cards[0]) == 0  # equal values stay linked and valid
    assert re.search(r"\d+\.\d+\.\d+\.\d+", got[2].pseudonymised)[0] in out
    assert (got[3].pseudonymised, got[4].pseudonymised, got[5].pseudonymised) == (None, "", "clean 12 words")
    assert pseudonyms.report(no_docs).collect() == []


def plain_pseudonyms(text, key):
    """The same values by plain integers: patterns from the module, everything else anew."""
    def feistel(x, a, b, kind):
        f = lambda i, h: int(hashlib.sha256(f"{key}|{kind}|{i}|{h}".encode()).hexdigest()[:15], 16)
        left, right = divmod(x, b)
        for i in range(8):
            if i % 2 == 0:
                left = (left + f(i, right) % a) % a
            else:
                right = (right + f(i, left) % b) % b
        return left * b + right

    luhn = lambda ds: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(ds))) % 10

    def refill(shape, ds):
        it = iter(ds)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def one(m):
        v = m[0]
        ds = re.sub(r"\D", "", v)
        if "@" in v:
            tag = hashlib.sha256(f"{key}|email|{v.lower()}".encode()).hexdigest()[:20].translate(str.maketrans("0123456789", "ghijklmnop"))
            return f"{tag}@example.{v.rsplit('.', 1)[1]}"
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
            parts = [int(x) for x in v.split(".")]
            if max(parts) > 255:
                return v
            n = feistel(sum(x << s for x, s in zip(parts, (24, 16, 8, 0))), 65536, 65536, "ipv4")
            return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
            area, group, serial = int(ds[:3]), int(ds[3:5]), int(ds[5:])
            if area in (0, 666) or area > 899 or not group or not serial:
                return v
            areas = [x for x in range(1, 900) if x != 666]
            n = feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 88902, 9999, "ssn")
            return refill(v, f"{areas[n // 989901]:03d}{n // 9999 % 99 + 1:02d}{n % 9999 + 1:04d}")
        if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", v):
            form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y" if "." in v else "%m/%d/%Y"
            try:
                day = (datetime.datetime.strptime(v, form) - datetime.datetime(1900, 1, 1)).days
            except ValueError:
                return v
            if not 0 <= day < 73049:
                return v
            day = feistel(day, 271, 270, "date")
            while day >= 73049:
                day = feistel(day, 271, 270, "date")
            return (datetime.datetime(1900, 1, 1) + datetime.timedelta(days=day)).strftime(form)
        if len(ds) >= 13:
            if luhn(ds):
                return v
            n = len(ds) - 1
            body = f"{feistel(int(ds[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), 'card'):0{n}d}"
            return refill(v, body + next(c for c in "0123456789" if not luhn(body + c)))
        a, e, line = int(ds[-10:-7]), int(ds[-7:-4]), int(ds[-4:])
        if a >= 200 and e >= 200:
            n = feistel(((a - 200) * 800 + e - 200) * 10000 + line, 80000, 80000, "phone")
            new = (n // 8000000 + 200, n // 10000 % 800 + 200, n % 10000)
        else:
            n = feistel((a * 1000 + e) * 10000 + line if a < 200 else 2 * 10**9 + ((a - 200) * 200 + e) * 10000 + line, 60000, 60000, "other phone")
            new = (n // 10**7, n // 10000 % 1000, n % 10000) if n < 2 * 10**9 else ((n - 2 * 10**9) // 2000000 + 200, (n - 2 * 10**9) // 10000 % 200, n % 10000)
        return refill(v, ds[:-10] + f"{new[0]:03d}{new[1]:03d}{new[2]:04d}")

    return re.sub(pseudonyms.ANY, one, text) if re.search(pseudonyms.QUICK, text) else text


def test_pseudonyms_by_plain_integers(spark):
    r = random.Random(5)
    d3 = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    values = [f"({d3(3)}) {d3(3)}-{d3(4)}" for _ in range(40)] + [f"+1 {d3(3)}-{d3(3)}-{d3(4)}" for _ in range(20)] + [f"{d3(3)}-{d3(2)}-{d3(4)}" for _ in range(60)] + ["667-01-0001", "665-99-9999", "899-12-0001", "123-00-1234", "001-01-0000"]
    values += [f"{d3(4)}-{d3(2)}-{d3(2)}" for _ in range(30)] + ["2024-02-29", "31.12.2099", "12/31/1900", "01.01.1899"] + [".".join(str(r.randrange(290)) for _ in range(4)) for _ in range(30)]
    values += [d3(n) for n in range(12, 21) for _ in range(12)] + ["3782 822463 10005", "3782-822463-10005", "x.y+z@mail.example-site.co.uk", "A.B@c.io", "a@b", "@c.d", f"{'k' * 64}@m.org", f"{'k' * 65}@m.org"]
    texts = [f"v {v}, {r.choice(values)}; é {v}" for v in values] + [None, "", "-".join(values[:50])]
    d = spark.createDataFrame([(i, t, 1, "v") for i, t in enumerate(texts)], "_found long, text string, n_card int, `a.b` string")
    out = pseudonyms.pseudonymise(d, "s3cret").collect()
    for row in out:
        assert row.pseudonymised == (None if row.text is None else plain_pseudonyms(row.text, "s3cret")), row.text
    assert {"_found", "a.b"} <= set(out[0].asDict()) and sum(row.n_phone for row in out) > 100
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(d, "")


def test_pseudonyms_take_linear_time(spark):
    began = time.time()
    d = spark.createDataFrame([(1, "q" * 2_000_000 + " @"), (2, "a." * 500_000 + "@"), (3, "1" * 1_000_000 + "@")], "doc_id long, text string")
    assert [r.pii_kinds for r in pseudonyms.report(d).collect()] == ["", "", ""] and time.time() - began < 60


def test_feistel_is_a_permutation(spark):
    n = 1000
    x = spark.range(n).select(F.sort_array(F.collect_list(pseudonyms.feistel(F.col("id"), 25, 40, F.lit("k"), "t"))).alias("v")).first().v
    assert x == list(range(n))


def test_secrets(spark, no_docs):
    rows = [
        (1, "é password = 'abcdefghijkl' Token:short api-key: x API_KEY=\"ABCDEFGHIJKLMNOP\""),
        (2, "AKIAABCDEFGHIJKLMN and AKIASHORT 0123456789abcdef0 deadbeef"), (3, None), (4, ""),
        (5, "password: secret: abcdefghijkl"), (6, "pwd is Tr0ub4dor&3xQz! and pin: 1999"), (7, "password: passwordpassword1999")]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[d].n_assign, got[d].n_access, got[d].n_hex) for d in range(1, 8)] == [(2, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    assert got[2].spans == "access:0:18,hex:33:50" and got[2].base_sha256 == sha(got[2].spans)
    assert got[6].spans == "guess:7:21" and got[3].spans == ""
    assert secrets.scan_secrets(no_docs).collect() == []


def test_secrets_in_more_contexts():
    def found(text):
        return [text[s:e] for s, _, e in secrets.method_spans(text, secrets.base_spans(text), 8.0)]

    for text, value in (
        ("DB_PASSWORD=Tr0ub4dor&3xQ!", "Tr0ub4dor&3xQ"), ("client_secret: k9#Vz!p2$Lq8", "k9#Vz!p2$Lq8"), ("mysql_pwd=Zx9!kQ2#vB7", "Zx9!kQ2#vB7"),
        ('{"x-auth-token": "k9#Vz!p2$Lq8"}', "k9#Vz!p2$Lq8"), ("Authorization: Bearer Zx9kQ2vB7mN4tR8s", "Zx9kQ2vB7mN4tR8s"),
        ('-H "authorization: bearer zxkqvbmntrws"', "zxkqvbmntrws"), ("use Bearer Zx9kQ2vB7mN4tR8s.", "Zx9kQ2vB7mN4tR8s"), ("Bearer token: k9#Vz!p2$Lq8", "k9#Vz!p2$Lq8"),
        ("pwd=xkqvbnmzplw", "xkqvbnmzplw"), ("pwd => xkqvbnmzplw", "xkqvbnmzplw"), ("password: secret: xkqvbnmzplw", "xkqvbnmzplw"),
        ("the password is xkqvbnmzplw", None), ("the bearer carried everything", None), ("Authorization: Bearer", None), ("pwd=passwordpassword", None),
        ("compass: Zx9kQ2vB7mN4", None), ("AWS_SECRET_ACCESS_KEY=x9$kQ2!mWz7pL", "x9$kQ2!mWz7pL"), ("password := k9#Vz!p2$Lq8", "k9#Vz!p2$Lq8"), ("passphrase: kqzvwmxtrplbhgndycfj", "kqzvwmxtrplbhgndycfj"),
        ("passphrase: government approval", None), ("pwd=governmentapproval", None),
        ("my password was k9#Vz!p2$Lq8, then", "k9#Vz!p2$Lq8"), ("the password was changedyesterday", None), ("client_secret_id = k9#Vz!p2$Lq8", "k9#Vz!p2$Lq8"),
        ("dbPassword=k9#Vz!p2$Lq8", "k9#Vz!p2$Lq8"), ("token-for-ci: xkqvbnmzplw", "xkqvbnmzplw"), ("token_count = 1234567890123", None), ("pass_a_b_c_d = k9#Vz!p2$Lq8", None)):
        assert found(text) == ([value] if value else []), text
    assert found("password: " * 50_000) == []  # restarts stay linear


KEYS = sorted(
    "pass password passwd passphrase passcode pwd secret token credential credentials auth authorization bearer apikey api_key api-key accesskey access_key access-key privatekey private_key private-key login pin".split(),
    key=len, reverse=True)
alnum = lambda c: c.isascii() and c.isalnum()


def plain_contexts(text):
    """Spans of the method character by character, without a pattern."""

    def value_at(j):
        j += text[j : j + 1] in ("'", '"') and j < len(text)
        k = j
        while k < len(text) and text[k] not in " \t\n\r\f\v\"'<>|":
            k += 1
        return (j, k) if k - j >= 4 else None

    def spaces(j):
        while text[j : j + 1] == " ":
            j += 1
        return j

    def context(i):
        """(separator, whether the name goes on, start and end of the value) of a context that begins here."""
        if i and alnum(text[i - 1]) and not ("a" <= text[i - 1] <= "z" and "A" <= text[i] <= "Z"):
            return None
        for key in (k for k in KEYS if text[i : i + len(k)].lower() == k):
            j, parts = i + len(key), 0
            while parts < 3 and text[j : j + 1] in ("_", "-") and alnum(text[j + 1 : j + 2]):
                j, parts = j + 2, parts + 1
                while alnum(text[j : j + 1]):
                    j += 1
            j = spaces(j + (text[j : j + 1] in ("'", '"') and j < len(text)))
            for sep in (":=", "=>", ":", "=", "is", "was"):
                word = lambda c: alnum(c) or c == "_"
                if text.startswith(sep, j) and not (sep.isalpha() and (word(text[j - 1]) or word(text[j + len(sep) : j + len(sep) + 1]))) and (v := value_at(spaces(j + len(sep)))):
                    return sep, parts > 0, *v
        if text[i : i + 6].lower() == "bearer" and text[i + 6 : i + 7] == " " and (v := value_at(spaces(i + 6))):
            return None, False, *v
        return None

    base, out, i, led = secrets.base_spans(text), [], 0, None
    fresh = False  # is this the place where a keyword stood as a value?
    while i < len(text):
        found = context(i)
        if not found:
            i, fresh = i + 1, False
            continue
        sep, more, a, b = found
        sep = sep or (led if fresh else None)
        value = text[a:b].rstrip(".,;:!?)")
        if value.rstrip("=:").lower() in KEYS:
            i, fresh, led = a, True, sep
            continue
        i, fresh = b, False
        covered = any(s <= a and a + len(value) <= e for s, _, e in base)
        prose = sep in (None, "is", "was") and value.isalnum() and not any(c.isdigit() for c in value)
        if len(value) >= 4 and not covered and not prose and not (more and value.isdigit()) and secrets.guess_log10(value) >= 8:
            out.append((a, 3, a + len(value)))
    return out


def test_contexts_by_characters():
    r = random.Random(11)
    bits = ["password", "Secret", "token", "api_key", "Bearer", "auth", "pwd", "login", "dbPassword", "compass", "_id", "-for-ci", "_2", " ", " ", " ", ":", "=", ":=", "=>", " is ", " was ", "'", '"', "k9#Vz!p2", "xkqvbnmzplw", "1234567890", "passwordpassword", ".", ",", "é", "\n", "<", "|"]
    some = 0
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        want = plain_contexts(text)
        assert secrets.method_spans(text, secrets.base_spans(text), 8.0) == want, text
        some += len(want)
    assert some > 300


def test_guess_cost():
    cost = secrets.guess_log10
    assert cost("password") < 1 < cost("p@ssw0rd1999") < cost("x9$kQ2!mWz7")
    assert cost("aaaaaaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 6 and cost("abcxyzabcxyzabcxyz") < cost("abcxyzkdmwqptzabce")
    brute = lambda s: sum(np.log10(secrets._pool(c)) for c in s)
    assert cost("zkvwpf") == pytest.approx(brute("zkvwpf"))
    assert cost("v" + "k7!" * 2000) < 100  # very long values stay linear


def plain_cost(value):
    """The same minimum over all segmentations by recursion."""
    rank, low = secrets.ranks(), value.lower()
    plain = low.translate(secrets.LEET)
    pool = lambda c: np.log10(secrets._pool(c))

    def costs(a, b):
        seg, out = low[a:b], []
        if (k := rank.get(seg) or rank.get(plain[a:b])) and b - a >= 2:
            out.append(np.log10(k + 1) + (0.7 if value[a:b] != seg else 0) + (0.5 if seg not in rank else 0))
        if b - a in (4, 6, 8) and seg.isdigit() and secrets._date(seg):
            out.append(np.log10(150 if b - a == 4 else 55_000))
        if b - a >= 3 and all(p in secrets.NEAR for p in zip(seg, seg[1:])):
            out.append(np.log10(47) + np.log10(2) * (b - a - 1))
        if b - a >= 3 and len(set(value[a:b])) == 1:
            out.append(pool(value[a]) + np.log10(b - a))
        for size in range(2, 9):
            if (b - a) % size == 0 and b - a > size and value[a:b] == value[a : a + size] * ((b - a) // size):
                out.append(sum(map(pool, value[a : a + size])) + np.log10((b - a) // size))
        return [*out, sum(map(pool, value[a:b]))]

    def least(a, k):
        if a == len(value):
            return np.log10(float(math.factorial(k)))
        return min(min(costs(a, b)) + least(b, k + 1) for b in range(a + 1, len(value) + 1))

    return least(0, 0)


def test_guess_cost_by_recursion():
    r = random.Random(6)
    words = ["pass", "P@ss", "the", "2019", "qwe", "aaa", "abab", "x9", "!", "zk", "0412", "government"]
    for _ in range(60):
        value = "".join(r.choice(words) for _ in range(4))[:9]
        assert secrets.guess_log10(value) == pytest.approx(max(0.0, plain_cost(value))), value
    assert secrets.guess_log10("ab!" * 3000 + "kq7") < 20 < secrets.guess_log10("".join(r.choice("bcdfghjkmnpqrtvwxz") for _ in range(3000)))


def test_secrets_base_spans_by_scan(spark):
    r = random.Random(8)
    bits = ["password", "API-KEY", "api_key", "Token", "secret", ":", "=", " ", "\"", "'", "AKIA", "ABCDEFGHIJKLMN0123", "deadbeef", "0123456789abcdef", "short", "x/y+z=._-ABCDEFGH", "é", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(30)) for _ in range(120)]

    def plain(text):
        out = []
        for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
            if len(m[1]) >= 12:
                out.append((m.start(), 0, m.end()))
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))

    got = {x.doc_id: x for x in secrets.scan_secrets(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == sha(plain(t)) and [x for x in got[i].spans.split(",") if x and not x.startswith("guess")] == [x for x in plain(t).split(",") if x]


def test_packing(docs, no_docs):
    got = packing.pack_documents(docs, capacity=64).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1]) and sum(p.length for p in own) == len(ids)
        assert all(p.length == 64 for p in own[1:])
        assert all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in own)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and s[-1][0] + s[-1][1] <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.pack_documents(no_docs).collect() == []


def test_special_tokens_and_edge_rows_are_packed(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"{end} hi", f"a {end}", f"  x{end}{end}  y \n", end, f"x <|end{end}oftext|>", " lead", "", None, "twice", "twice", "a  b\u00a0\u3000c", "x" * 5000]
    rows = [(None if i == 3 else 7 if x == "twice" else i, x, "k", "v") for i, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, length string, `a.b` string")
    got = packing.pack_documents(d, capacity=64).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) - 64 * ((len(ids) - 1) // 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += Counter((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 64
    held = {(r.sequence_id, r.offset) for r in got}
    assert len(held) == len(got) and all(r.offset == 0 or any(s == r.sequence_id and o < r.offset for s, o in held) for r in got)


def test_configurations_use_all_counts():
    sizes = [(60, 5), (40, 7), (33, 4), (10, 20), (7, 3)]
    used = Counter()
    for times, parts in packing.configurations(sizes, 64):
        assert sum(sizes[g][0] * m for g, m in parts) <= 64
        for g, m in parts:
            used[g] += times * m
    assert [used[i] for i in range(5)] == [n for _, n in sizes]


def brute_base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, no_docs):
    for r in quality.verdicts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, *rest = brute_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and (r.kept is False or not r.base_failed)
    kept = quality.kept_only(docs)
    assert kept.columns == docs.columns and kept.count() > 10
    assert quality.verdicts(no_docs).collect() == []


def test_neighbours(spark):
    good, bad = "the quick fox is in the wood and it runs ", "BUY!! NOW!! ### $$$ CHEAP!! "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 7)) for i in range(300)] + [(300, None), (301, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in neighbours.classify(d, labels).collect()}
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(i % 3 > 0)
    assert got[300].score == got[301].score and 0 <= got[300].score <= 1
    # labels of the held-out fold are never used
    flipped = labels.withColumn("quality", F.when(neighbours.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in neighbours.classify(d, flipped).collect()} == {k: r.score for k, r in got.items()}
    assert {r.score for r in neighbours.classify(d, labels.limit(0)).collect()} == {0.5}


def plain_terms(text):
    """Term counts of a text by loops: byte bigrams by a multiplicative hash, then shapes of words."""
    own, out = (text or "").encode(), np.zeros(neighbours.TERMS)
    for x, y in zip(own, own[1:]):
        out[(((x << 8 | y) * 0x9E3779B97F4A7C15 % 2**64) >> 40) % (neighbours.TERMS - neighbours.SHAPES) + neighbours.SHAPES] += 1
    mark = lambda c: 33 <= c < 127 and not chr(c).isalnum()
    before = None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", own):
        upper, marks, digit = sum(65 <= c < 91 for c in w), sum(map(mark, w)), any(48 <= c < 58 for c in w)
        for term in ((min(upper, 2) * 4 + min(marks, 3)) * 2 + digit, 24 + min(len(w), 31), 56 + w[-1] % 32 if mark(w[-1]) else 88, 89 if w == before else 90):
            out[term] += 1
        before = w
    return out


def test_neighbours_terms_do_not_depend_on_the_batch():
    texts = ["", "q", " ", "ab", "BUY now!! now!!", "q", "é7"]
    own = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, own)])
    together = neighbours.counts(np.frombuffer(b"".join(own), np.uint8), at)
    for t, b, row in zip(texts, own, together):
        alone = neighbours.counts(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert (alone == row).all() and (plain_terms(t) == row).all(), t


def test_neighbours_vote_by_loops(spark):
    """Scores by loops from plain counts and plain algebra. With as many labelled texts as directions, the latent space is the span of
    the labelled vectors, so cosines follow from projecting on it. Odd labels and rows; of texts that share an id the smallest is learnt."""
    r = random.Random(3)
    usable = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][: neighbours.RANK]
    prose = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABC#!7é") for _ in range(r.randrange(1, 9))) for _ in range(30))
    rows = [(i, prose()) for i in range(usable[-1] + 1)] + [(None, "x y"), (usable[4], "!again " + prose()), (usable[9], "zz " + prose()), (900, None), (901, "q"), (902, " "), (903, "")]
    d = spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, y string").repartition(5)
    y = {i: r.randrange(2) for i in range(usable[-1] + 1)}
    labels = spark.createDataFrame([(i, v, 0) for i, v in y.items()] + [(usable[0], 0, 0), (950, 1, 0), (951, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((repr(x.doc_id), round(x.score, 6)) for x in neighbours.classify(d, labels).collect())
    learnt = [min(t for i, t in rows if i == u) for u in usable]
    x = np.array([plain_terms(t) for t in learnt])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    weigh = lambda c: np.log1p(1000 * c / max(c.sum(), 1)) * idf
    x = np.array([weigh(c) / np.linalg.norm(weigh(c)) for c in x])
    span = np.linalg.qr(x.T)[0]
    want = []
    for i, t in rows:
        c = plain_terms(t)
        if not c.sum():
            want.append((repr(i), sum(y[u] for u in usable) / len(usable)))
            continue
        z = weigh(c) @ span
        near = sorted(((float(z @ (v @ span)) / np.linalg.norm(z), k) for k, v in enumerate(x)), reverse=True)[: neighbours.NEAREST]
        w = [max(s, 0) ** neighbours.POWER for s, _ in near]
        want.append((repr(i), sum(a * y[usable[k]] for a, (_, k) in zip(w, near)) / sum(w)))
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-3)


def brute_mix(rows, share, epochs, seed):
    """rows: (doc_id, leaf, tokens, text)."""
    leaves = {}
    for d, leaf, n, t in rows:
        leaves.setdefault(leaf, []).append((d, n, t))
    given = mixing.budgets([(k, sum(n for _, n, _ in v)) for k, v in leaves.items()], share * sum(r[2] for r in rows), epochs, mixing.default_weight)
    out = []
    for leaf, own in leaves.items():
        total = sum(n for _, n, _ in own)
        whole = min(given[leaf] // total, epochs) if total else 0
        out += [(d, e) for e in range(whole) for d, _, _ in own]
        if whole < epochs:
            at = lambda d, t: int(hashlib.md5(f"{seed}|{whole}|{d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16)  # noqa: B023, E731
            left = given[leaf] - whole * total
            for d, n, _ in sorted(own, key=lambda x: at(x[0], x[2])):
                if n > left:
                    break
                left -= n
                out.append((d, whole))
    return sorted(out)


def test_mixing(docs, no_docs, monkeypatch):
    rows = [(r.doc_id, (r.d, r.lang, r.source), len(words(r.text)), r.text) for r in docs.withColumn("d", mixing.domain_of(F.col("source"))).collect()]
    for share, rng in ((0.8, 4096), (0.4, 8), (1.7, 8)):
        monkeypatch.setattr(mixing, "RANGE_ROWS", rng)
        got = sorted((r.row.f0, r._epoch) for r in mixing.mixed(docs, share).collect())
        assert got == brute_mix(rows, share, mixing.EPOCHS, mixing.SEED)
    assert mixing.chosen_docs(docs).columns == docs.columns
    assert mixing.selection(no_docs).collect() == []


def test_shortages_stay_among_siblings():
    leaves = [(("a", "x", "1"), 10), (("a", "x", "2"), 1000), (("b", "x", "3"), 1000)]
    assert mixing.budgets(leaves, 400, 1, lambda p: 1.0) == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("b", "x", "3"): 200}
    assert mixing.budgets([(("a", "x", "1"), 10), (("b", "x", "3"), 1000)], 400, 1, lambda p: 1.0) == {("a", "x", "1"): 10, ("b", "x", "3"): 390}
