"""Secrets, personal data, lines, language, packing and pages: brute force, round trip, held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import html_text, language, lines, packing, pii, secrets
from llm_cases import LONG, ODD, documents, prose

# ---- secrets -------------------------------------------------------------------------------------------------

SECRET_RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def spans_by(rules, text):
    found = sorted((m.start(), k, m.end()) for k, (_, r, ok) in enumerate(rules) for m in r.finditer(text or "") if ok(m))
    return [f"{rules[k][0]}:{a}:{e}" for a, k, e in found]


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_secrets_equal_brute_force(spark):
    r = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = ["é ß ", "password = token: ", "API_KEY=\"", "ToKeN:", "AKIA", " x-", "\n", "deadbeef", "😀", "secretsecret=passwd:abcdefghijklmnop ", "ſecret=abcdefabcdef1234 "]
    rows = [(1000 + i, "".join(r.choice(bits) + "".join(r.choices(chars, k=r.randint(0, 30))) for _ in range(r.choice([1, 3, 150])))) for i in range(120)]
    rows += [r for r in ODD if r[0] not in (None, 7)]
    got = {x.doc_id: x for x in secrets.op3_secrets(documents(spark, rows)).collect()}
    for d, text, *_ in rows:
        want = spans_by(SECRET_RULES, text)
        x = got[d]
        assert x.base_sha256 == sha(want) and (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(x.spans.split(","))
    assert len(got) == len(rows) and secrets.op3_secrets(documents(spark, [])).count() == 0


def test_battery_tells_random_from_patterned(spark):
    r = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_ones = [(i, "key " + "".join(r.choices(chars, k=40)) + " end") for i in range(200)]
    patterned = [(1000 + i, "id " + ("aB3" * 14)[:40] + " end") for i in range(100)] + [(2000 + i, "x " + "AAAAAAAAAAAAAAAAAAAAbbbbbbbbbbbbbbbbbbb1 end") for i in range(100)]
    got = {x.doc_id: x.spans for x in secrets.op3_secrets(documents(spark, random_ones + patterned)).collect()}
    assert sum("random:4:44" == got[i] for i, _ in random_ones) >= 170
    assert not any("random" in got[i] for i, _ in patterned)


def test_long_words_are_no_secrets(spark):
    words = """compartmentalization internationalization counterrevolutionaries electroencephalographically deinstitutionalization uncharacteristically
        electroencefalografista constitucionalizaciones desproporcionadamente institucionalizaciones contrarrevolucionarios
        anticonstitutionnellement institutionnalisation intergouvernementalisation radioelectriciennes industrialisationnelles
        Geschwindigkeitsbegrenzung Bundesverfassungsgericht Donaudampfschifffahrtsgesellschaft Lebensversicherungsgesellschaften Arbeiterunfallversicherungsgesetz
        getUserAccountInformation createDatabaseConnection setApplicationEnvironment initializeComponentRegistry updateCustomerPreferences""".split()
    rows = [(i, f"one {w} two") for i, w in enumerate(w for w in words if len(w) >= 20)]
    assert len(rows) > 20
    got = {r.doc_id: r.spans for r in secrets.op3_secrets(documents(spark, rows)).collect()}
    assert [rows[i][1] for i in got if got[i]] == []
    r = random.Random(3)
    letters = [(i, "key " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz" + ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if i % 2 else ""), k=24 + i % 17))) for i in range(200)]
    got = secrets.op3_secrets(documents(spark, letters)).collect()
    assert sum("random" in x.spans for x in got) >= 170


def test_random_tokens_of_every_alphabet_are_found(spark):
    r = random.Random(8)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda chars, k: "".join(r.choices(chars, k=k))
    kinds = [lambda: of(low + dig + "-_", 36), lambda: "-".join(of(dig + "abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(of(up + dig, 5) for _ in range(6)),
             lambda: of(low, 32), lambda: of(up + low, 32), lambda: of(up, 24), lambda: of(up + low + dig + "+/-_", 40)]
    rows = [(100 * k + i, f"see {make().strip('+/-_')} end") for k, make in enumerate(kinds) for i in range(40)]
    path = "articles/the-state-of-the-nation-and-the-rest/"
    rows += [(1000 + i, f"see {path}{of(low + dig, 32)} end") for i in range(40)]
    rows += [(2000 + i, f"see {path}{'-'.join(['the', 'state', 'of', 'the', 'nation'] * 3)} end") for i in range(40)]
    got = {x.doc_id: x.spans for x in secrets.op3_secrets(documents(spark, rows)).collect()}
    for k in range(len(kinds)):
        assert sum(got[100 * k + i] == f"random:4:{len(rows[40 * k + i][1]) - 4}" for i in range(40)) >= 34, k
    at = 4 + len(path)
    assert sum(got[1000 + i] == f"random:{at}:{at + 32}" for i in range(40)) >= 34
    assert not any(got[2000 + i] for i in range(40))


# ---- personal data -------------------------------------------------------------------------------------------

def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(digits(s)[::-1])) % 10 == 0


PII_RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(m[0])),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m[0])) <= 15)]
PARTS = ["a@b.c", "_x@d.e", "@", ".", "user.name+tag@mail-1.example.co", "1.2.3.4", "5.6.7", "255.256.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
         "+1 (555) 010-9999", "+49 30 1234567", "+", "(", " ", "é", "😀", "12", "-", "3", "000", "\n", "Call Dr. Maria Smith", "John Miller", "2023-01-05", "phone 555 123 4567", "٣", "x"]


def test_base_spans_equal_brute_force():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 20)))
        assert [f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in pii.base_spans(text)] == spans_by(PII_RULES, text), text


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "." * 300_000, "@" * 100_000, "1 " * 100_000])
def test_long_runs_take_linear_time(text):
    pii.candidates(text, pii.base_spans(text))


def test_pii_query(spark):
    rows = [(100 + i, f"{prose(i, 5)} Call Dr. Maria Smith or John Miller, phone 555 123 4567, order 1234567, mail {'ab' * (1 + i % 3)}@mail.example.com from 10.0.0.{i}") for i in range(60)]
    rows += [r for r in ODD if r[0] not in (None, 7)]
    got = {x.doc_id: x for x in pii.op9_pii(documents(spark, rows)).collect()}
    for d, text, *_ in rows:
        want = spans_by(PII_RULES, text)
        assert got[d].base_sha256 == sha(want) and (got[d].n_email, got[d].n_ip) == tuple(sum(s.startswith(k) for s in want) for k in ("email", "ip"))
        assert set(want) <= set(got[d].spans.split(","))
    added = got[100].spans
    assert added.count("name:") == 2 and "phone:" in added and got[6].spans == ""
    assert pii.op9_pii(documents(spark, [])).count() == 0
    text = pii.redacted(documents(spark, rows).where("doc_id in (100, 1, 2)")).where("doc_id = 100").first().text
    assert "[email]" in text and "[ip]" in text and "example.com" not in text


def test_em_finds_the_unreliable_labeler():
    r = random.Random(3)
    counts = collections.Counter()
    for i in range(4000):
        truth = i % 2
        vote = lambda right: (1 if (r.random() < right) == bool(truth) else -1)
        counts[pii.key_of(pii.PHONE, ((1 if truth else -1) if i % 10 == 0 else 0, vote(.9), vote(.9), vote(.5), vote(.8)), 12)] += 1
    _, p, yes = pii.reliabilities(counts)
    assert p[1, 1, 1] > 0.85 and p[1, 2, 1] > 0.85 and abs(p[1, 3, 1] - 0.5) < 0.05 and 0.7 < p[1, 4, 1] < 0.9
    assert yes[pii.key_of(pii.PHONE, (0, 1, 1, -1, 1), 12)] > 0.9 > 0.1 > yes[pii.key_of(pii.PHONE, (0, -1, -1, 1, -1), 12)]
    for key in counts:
        kind, vote, length = pii.parts_of(key)
        assert pii.key_of(kind, vote, 8 * length) == key


# ---- lines ---------------------------------------------------------------------------------------------------

def plain_deleted(docs, least):
    """Lines in a run that equals an earlier run and has at least `least` words: longest previous factor of each suffix."""
    ids, seqs, at, out = {}, [], collections.defaultdict(list), collections.defaultdict(set)
    size = lambda line: len(line.encode().split())
    for d, text in sorted(docs, key=lambda x: x[0]):
        own = [(j, x) for j, x in enumerate((text or "").split("\n")) if size(x)]
        seqs.append(([j for j, _ in own], [ids.setdefault(x, len(ids)) for _, x in own], [size(x) for _, x in own], d))
    for s, (nums, seq, words, d) in enumerate(seqs):
        for i in range(len(seq)):
            best = 0
            for s2, i2 in at[seq[i]]:
                n = 0
                while i + n < len(seq) and i2 + n < len(seqs[s2][1]) and seq[i + n] == seqs[s2][1][i2 + n]:
                    n += 1
                best = max(best, n)
            if sum(words[i:i + best]) >= least:
                out[d].update(nums[i:i + best])
            at[seq[i]].append((s, i))
    return out


@pytest.mark.parametrize("least", [1, 7])
def test_lines_equal_brute_force(spark, least):
    r = random.Random(least)
    texts = ["a", "b b", "c c c", "d", "e e e e e", "", "  ", "f f f f f f f f f f f", "é 😀"]
    docs = [(i, "\n".join(r.choice(texts) for _ in range(r.randint(1, 30)))) for i in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "z y\n" * 300), (1004, prose(3) + "\n" + prose(4)), (1005, prose(5) + "\n" + prose(3) + "\n" + prose(4))]
    want = plain_deleted(docs, least)
    got = {x.doc_id: x for x in lines.deduplicated(documents(spark, docs), least).collect()}
    for d, text in docs:
        assert list(got[d]["_deleted"]) == sorted(want.get(d, ()))
        assert got[d].text == (None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in want.get(d, ())))
    assert want[1005] and got[1005].source == "s"


def test_lines_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 5]
    got = lines.op5_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 7] == ["", ""]  # both rows are one document, a copy of 6
    assert lines.op5_lines(documents(spark, [])).count() == 0


# ---- language ------------------------------------------------------------------------------------------------

SYLLABLES = {"aa": "ka lo mi te ru".split(), "bb": "sch tz enb ung ch".split(), "cc": "eau oix que tre ment".split()}


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


def test_language_accuracy_and_odd_rows(spark):
    rows = [(i, speech(lang, i), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 _ !!", "cc"), (1003, speech("aa", 1), None), (1004, speech("bb", 4) * 400, "cc"), (None, speech("cc", 9), "cc")]
    got = {r.doc_id: r for r in language.op7_language(documents(spark, rows)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert 60 < len(held) < 140 and all(got[d].lang_pred == lang for d, _, lang in held)
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1002].score == 0 and got[1002].rejected
    assert got[1003].lang_pred == "aa" and got[1004].lang_pred == "bb" and got[None].lang_pred == "cc" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.identified(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and kept.where("doc_id < 300").count() == 300 and kept.where("doc_id in (1000, 1001, 1002)").count() == 0


def test_language_without_labels(spark):
    docs = documents(spark, [(1, speech("aa", 1), None), (2, None, "aa")])
    assert {r.lang_pred for r in language.op7_language(docs).collect()} == {"und"}
    assert language.op7_language(documents(spark, [])).count() == 0


def test_held_out_is_crc32(spark):
    rows = documents(spark, [(i, "x") for i in range(50)]).select("doc_id", language.held_out(F.col("doc_id"))).collect()
    got = {d: held for d, held in rows}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


# ---- packing -------------------------------------------------------------------------------------------------

def test_best_fit_decreasing_equals_plain_search():
    r = random.Random(4)
    for row in (1, 2, 7, 64, 100):
        lengths = sorted((r.randint(1, row) for _ in range(300)), reverse=True)
        room, want = [], []
        for need in lengths:
            fits = [x for x in room if x >= need]
            want.append(min(fits) if fits else row)
            if fits:
                room.remove(min(fits))
            room.append(want[-1] - need)
        used = collections.defaultdict(int)
        got = []
        for need, at in zip(lengths, packing.best_fit_decreasing(lengths, row)):
            got.append(row - used[at])
            used[at] += need
        assert got == want and max(used.values()) <= row


def test_packing_is_lossless(spark):
    import numpy as np
    rows = [(i, prose(i, 1 + i * 7 % 120)) for i in range(60)] + [(100, LONG), (101, "é 😀 <|endoftext|> \n\n  x"), (102, None), (103, ""), (104, "   ")]
    packed = packing.pack(documents(spark, rows), row=256, shard_bytes=20_000)
    back = {r.doc_id: r.text for r in packing.unpacked(packed, row=256).collect()}
    assert back == {d: t for d, t, *_ in rows if t}
    n = tokens = 0
    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256 and len(r.cu_seqlens) == len(r.doc_ids) + 1 == len(r.pieces) + 1
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
        assert (ids[r.n_tokens:] == packing.EOS).all()
        n, tokens = n + 1, tokens + r.n_tokens
    assert tokens / (n * 256) > 0.95
    assert packing.pack(documents(spark, [])).count() == 0
    odd = packing.pack(documents(spark, ODD), row=256).selectExpr("explode(doc_ids) as d").groupBy("d").count().collect()
    assert {r.d for r in odd} == {None, 3, 4, 5, 6, 7, 8, 9}


def test_rows_that_share_a_doc_id_spread_over_shards(spark):
    rows = [(None, prose(i, 60)) for i in range(400)] + [(7, prose(1000 + i, 60)) for i in range(400)] \
        + [(None, prose(2000, 60))] * 3000 + [(9, prose(2001, 600))] * 300 + [(i + 10, prose(3000 + i, 60)) for i in range(100)]
    packed = packing.pack(documents(spark, rows), row=256, shard_bytes=20_000)
    ids = packed.selectExpr("shard", "n_tokens", "explode(doc_ids) as d")
    assert {r.d: r["count"] for r in ids.groupBy("d").count().where("d is null or d = 7").collect()}[None] >= 3400
    shards = [r[1] for r in packed.groupBy("shard").sum("n_tokens").collect()]
    assert max(shards) <= 3 * sum(shards) / len(shards)
    words = packed.selectExpr("explode(arrays_zip(doc_ids, pieces)) as s").groupBy("s.doc_ids", "s.pieces").count().collect()
    got = {(r.doc_ids, r.pieces): r["count"] for r in words}
    assert got[9, 0] == 300 and all(got[i + 10, 0] == 1 for i in range(100))
    want = sum(len(packing.encoding(packing.VOCABULARY).encode_ordinary(t)) + 1 for _, t in rows)
    assert sum(shards) == want  # every copy is there
    order = ["shard", "row"]
    again = packing.pack(documents(spark, rows).repartition(5), row=256, shard_bytes=20_000)
    assert packed.orderBy(order).collect() == again.orderBy(order).collect()


# ---- pages ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div id="main-menu"><a href="1">Home</a> <a href="2">News</a></div><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<div class="content"><h1>Big &amp; title</h1><p>First para with <a href="x>y">a link</a> in
 it&nbsp;and more.<div class="advert"><p>Buy now</p></div><p>Second <b>bold</b>text &lt;tag&gt; 3 < 4.<br>After break<ul><li>one item<li>two items</ul></div>
<aside>side bar words</aside><section class="comments"><h3>Comments (3)</h3><p>I like this a lot, it is great.</p></section><form>Name <input></form><footer>(c)</footer></body>"""
WANT = "Big & title\nFirst para with a link in it and more.\nSecond boldtext <tag> 3 < 4. After break\none item\ntwo items"


def page(i, marked=True):
    inner = "".join(f"<p>{prose(i * 10 + k, 25)}</p>" for k in range(3))
    return f'<body><nav><ul><li><a href="/a">{prose(i, 3)}</a></li></ul></nav>' + (f"<article><h1>Head {i}</h1>{inner}</article>" if marked else f"<div><h1>Head {i}</h1>{inner}</div>") \
        + f'<div class="ad">{prose(i, 9)}</div><footer>&copy; {prose(i, 4)}</footer></body>'


def article(i):
    return "\n".join([f"Head {i}"] + [prose(i * 10 + k, 25) for k in range(3)])


def test_pages(spark):
    rows = [(i, "u", page(i, i % 5 > 0)) for i in range(40)] + [(100, "u", PAGE), (101, None, None), (102, "u", ""), (None, "u", "just text"), (104, "u", "<p></p>"),
                                                               (105, "u", "<article><p>" + LONG + "</article>"), (106, "u", "<div class=ad>x"), (1, "u", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = html_text.op8_main_text(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(by[i] == article(i) for i in range(40)) and by[100] == WANT
    assert by[101] == by[102] == by[104] == "" and by[None] == "just text" and by[105] == LONG
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.op8_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("before,after", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="content-sidebar-wrap">', "</div>"), ('<form id="aspnetForm">', "</form>"),
    ("<dialog open>", "</dialog>"), ('<div class="widget">', "</div>"), ('<div style="display:none">', "</div>"), ('<label class="modal">', "</label>")])
@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_wrappers_of_the_article_are_not_passed_over(before, after, mark):
    if mark == "div" and "none" in before:
        return  # hidden and not marked
    inner = f"<{mark}><h1>Head</h1><p>{prose(1, 40)}</p><p>{prose(2, 40)}</p></{mark}>"
    html = f'<body><nav><a href="/">{prose(3, 3)}</a></nav>{before}{inner}{after}<div class="ad">{prose(4, 9)}</div><footer>{prose(5, 4)}</footer></body>'
    p = html_text.Page(html)
    assert html_text.extract(html, {}) == f"Head\n{prose(1, 40)}\n{prose(2, 40)}"
    assert (p.label is not None) == (mark != "div")


def test_sections_of_an_article_are_kept():
    parts = [f'<section {names}><h2>Part {k}</h2><p>{prose(k, 40)}</p></section>' for k, names in enumerate(
        ('id="intro"', 'class="related-work"', 'id="discussion"', 'class="discussion"', 'id="legal-notice"'))]
    advert = '<div class="ad-300"><p>Buy now</p></div><div class="cookie-banner"><p>We use cookies</p></div>'
    html = f'<body><article>{advert.join(parts)}<div class="comments"><p>{prose(9, 300)}</p></div></article></body>'
    assert html_text.extract(html, {}) == "\n".join(f"Part {k}\n{prose(k, 40)}" for k in range(5))


def test_scan_finds_the_best_region():
    r = random.Random(6)
    for _ in range(200):
        kinds = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        scores = {"a": 2.0, "b": -1.0, "c": -3.0, "d": 0.5}
        p = html_text.Page("")
        p.kinds = kinds
        first, end = p.region(scores)
        total = lambda x, y: sum(scores[k] for k in kinds[x:y])
        assert total(first, end) == max(total(x, y) for x in range(len(kinds) + 1) for y in range(x, len(kinds) + 1))


@pytest.mark.parametrize("text", ["<" * 20_000, '<a "' * 20_000, "<!--" * 20_000, "<script>" * 5_000, '<div class="ad">x' * 5_000, "<p>" * 50_000, "&" * 50_000])
def test_broken_pages_take_linear_time(text):
    html_text.extract(text, {})


@pytest.mark.parametrize("scores", [{}, {"word:div": -1.0, "word:p": 2.0}])
@pytest.mark.parametrize("wrap", ["div", 'section class="story"', "article"])
def test_comments_never_are_the_article(wrap, scores):
    article, talk = prose(1, 40), prose(2, 200)
    end = wrap.split()[0]
    html = f"<body><nav>a b c</nav><{wrap}>{article}</{end}><h3>Comments</h3><div>{talk}</div><div>{talk}</div></body>"
    got = html_text.extract(html, scores)
    assert article in got and not any(w in got for w in talk.split() if w not in article and len(w) > 5) and "Comments" not in got
    assert html_text.extract(f"<h2>3 Comments</h2><p>{talk}</p>", scores) == ""
