import base64
import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from seqweave.llm import bpe, html_text, license_scan, quality_knn, quality_rules, toxicity, warc

from .conftest import hostile_rows

PATH = P.path(bpe.VOCABULARY)


def test_bpe_equals_the_library(hostile, nothing):
    ranks = bpe.load(PATH).ranks
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(PATH, P.PATTERN)
    rng = random.Random(3)
    texts = ["", " ", "a" * 3000, "  \n\n x", "'s I'll 123 ...!!", "é漢字🙂" * 50] + ["".join(rng.choice("abé \n1!漢'") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == lib.encode_ordinary(t) and codec.decode(ids).decode() == t
    got = Counter(tuple(r) for r in bpe.encode_digests(hostile, PATH, P.PATTERN, chars=1000).collect())
    want = Counter()
    for i, t, *_ in hostile_rows():
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode_digests(nothing, PATH, P.PATTERN).count() == 0
    back = bpe.encode(hostile, PATH, P.PATTERN).collect()
    assert Counter(r.text for r in back) == Counter(r[1] or "" for r in hostile_rows())
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Ranks({b"a": 0})


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha string, bytes long").repartition(2)


ROWS = [
    (3, "http://a/ b\r\nx", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, None), (4, "u", ""), (5, "u", "é漢" * 70000), (6, "u", "é漢" * 70000),
    (None, "n", "<p>one</p>"), (None, "n", "alone"), (7, "r", "twice"), (7, "r", "twice"),
]


@pytest.mark.parametrize("n", [bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 5000, 16384])
def test_bpe_long_matches_equal_the_library(n):
    ranks = bpe.load(PATH)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    rng = random.Random(n)
    for word in ("".join(rng.choice("etaoinshrdlu") for _ in range(n)), "ab" * (n // 2), "é漢" * (n // 5), "z" * n):
        (ids,) = bpe.encode_words([word.encode()], ranks)
        assert ids.tolist() == library.encode_ordinary(word)


def test_bpe_time_of_a_long_match_grows_with_its_length():
    began = time.process_time()
    word = "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(200_000)).encode()
    ids = bpe.encode_words([word], bpe.load(PATH))[0]
    assert time.process_time() - began < 15 and bpe.Codec(PATH, P.PATTERN).decode(ids.tolist()) == word


def test_warc_round_trip(spark):
    got = Counter(tuple(r) for r in warc.round_trip(pages(spark, ROWS)).collect())
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in ROWS:
        data = (h or "").encode()
        refers = None if first.get(h or "", i) == i else first[h or ""]
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(i, len(data), sha, "response" if refers is None else "revisit", refers)] += 1
    assert got == want
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_small_payloads_are_responses_with_a_limit(spark):
    rows = warc.revisits(pages(spark, ROWS), min_bytes=1000).collect()
    assert [(r.page_id, r.refers_to) for r in rows if r.refers_to is not None] == [(6, 5)]


def test_warc_archives_hold_dictionary_then_a_frame_a_record(spark, tmp_path):
    texts = [f"<html><p>{i} common boilerplate text of many pages {i * 7919}</p></html>" for i in range(400)]
    warc.write(pages(spark, [(i, f"u{i}", t) for i, t in enumerate(texts)]), str(tmp_path), archive_bytes=4000).collect()
    files = sorted(tmp_path.glob("*.warc.zst"))
    assert len(files) > 2 and not list(tmp_path.glob("_*"))
    data = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and size > 0
    records = list(warc.read_archive(data, "x"))
    assert all(data[at : at + 4] == struct.pack("<I", warc.FRAME) for at, _ in records)
    back = warc.read(spark, str(tmp_path)).collect()
    assert Counter(bytes(r.payload).decode() for r in back) == Counter(texts)
    packed = struct.pack("<II", warc.SKIPPABLE, len(z := zstandard.compress(data[8 : 8 + size]))) + z + data[8 + size :]
    assert [r["payload"] for _, r in warc.read_archive(packed, "x")] == [r["payload"] for _, r in records]


def frame(text):
    return struct.pack("<II", warc.SKIPPABLE, 0) + zstandard.compress(text)


@pytest.mark.parametrize(
    "data,message",
    [
        (b"", "dictionary"), (struct.pack("<II", warc.SKIPPABLE, 99), "cut off"), (frame(b"x")[:-2], "cut off|Zstandard"),
        (frame(b"HTTP/1.1 200\r\n\r\n"), "version"), (frame(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), "no warc-record-id"),
        (frame(warc.record(1, "u", b"abc", None).replace(b"abc", b"abcd")), "Content-Length"), (frame(warc.record(1, "u", b"abc", None).replace(b"abc", b"abd")), "digest"),
        (frame(warc.record(1, "u", b"abc", None)) + b"junk!!!!", "Zstandard"),
    ],
)
def test_warc_refuses_broken_archives(data, message):
    with pytest.raises(warc.WarcError, match=message):
        list(warc.read_archive(data, "bad"))


def test_warc_reads_ordinary_archives(spark, tmp_path):
    """A streaming writer's frames (no content size), a warcinfo first, other types, folded headers, other digests."""
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:{}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{}Content-Length: {}\r\n\r\n"

    def one(kind, name, block, more=""):
        return head.format(kind, name, more, len(block)).encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response\r\n"
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    md5 = f"WARC-Block-Digest: md5:{hashlib.md5(body).hexdigest()}\r\n"
    texts = [
        one("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"), one("request", "q", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n"),
        one("response", "r", body, http + "X-Long: a\r\n b\r\n" + md5), one("resource", "s", b"plain"), one("metadata", "m", b""),
        one("revisit", "v", b"", http + "WARC-Payload-Digest: sha1:ABC\r\nWARC-Refers-To: <urn:r>\r\n"),
        one("response", "t", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nab", http + "WARC-Truncated: length\r\n"),
    ]
    data = struct.pack("<II", warc.SKIPPABLE, 0)
    for t in texts:
        c = zstandard.ZstdCompressor().compressobj()
        data += c.compress(t) + c.flush()
    (tmp_path / "a.warc.zst").write_bytes(data)
    want = {"i": b"software: x\r\n", "q": b"GET / HTTP/1.1\r\n\r\n", "r": b"<p>hello</p>", "s": b"plain", "m": b"", "v": b"", "t": b"ab"}
    named = spark.createDataFrame([("a.warc.zst",)], "archive string")
    for rows in (warc.read(spark, str(tmp_path)), warc.read(spark, str(tmp_path), named)):
        rows = rows.collect()
        assert {r.record_id.removeprefix("urn:"): bytes(r.payload) for r in rows} == want and [r.record_type for r in rows][0] == "warcinfo"
    with pytest.raises(warc.WarcError, match="block digest"):
        warc.parse_record(texts[2].replace(b"hello", b"jello"), "x")


PROSE = "It was a long, quiet, and even day, with much to read, write, and think about, before the night came down again."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>a &amp; b&nbsp;c<br>d<p>e", "a & b c d\n\ne"), ("<script>var a='<p>x</p>'</script><p>y</p><style>p{}</style>", "y"),
        (f"<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</article><aside>{PROSE}</aside><footer>f</footer>", f"T\n\n{PROSE}\n\n{PROSE}"),
        (f"<div class='cookie-notice'>{PROSE}</div><div id=main><div><p>{PROSE}</p><p>{PROSE}</p></div></div><div id=comments><p>{PROSE}</p></div>", f"{PROSE}\n\n{PROSE}"),
        (f"<main><p>{PROSE}</p><form><p>{PROSE}</p></form><div hidden>x</div><div style='display:none'>x</div><ul><li>one<li>two</ul></main>", f"{PROSE}\n\none\n\ntwo"),
        (f"<article><p>{PROSE}<div class=ad>buy</div><p>end<!-- c --></article", f"{PROSE}\n\nend"), ("<article><p>x<b>y<p>z</article>", "xy\n\nz"),
        (f"<article><p>{PROSE}</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>", PROSE),
    ],
)
def test_html_main_text(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize(
    "wrapper",
    [
        "div class='content with-sidebar'", "div class=no-comments", "div class=overflow-hidden", "div class='elementor-widget elementor-widget-text'",
        "form action=/page.aspx", "div class=promotion", "div class='modal'", "dialog open", "fieldset", "object",
    ],
)
def test_html_keeps_the_bulk_of_a_page(wrapper):
    tag = wrapper.split()[0]
    page = f"<{wrapper}><h2 class=section-header>Head</h2><p>{PROSE}</p><section id=related-work><p>{PROSE}</p></section><div class=sidebar>x y</div></{tag}><div class=comments>{PROSE * 9}</div><footer>f</footer>"
    assert html_text.extract(page) == f"Head\n\n{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 40000 + "x", "<div>" * 20000 + f"<p>{PROSE}</p>" + "</div>" * 20000, "<ul><li>" * 20000 + "<a href=1>a</a>" * 3, "<b>" * 20000 + "<div>x</div>" * 20000,
        "<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>" * 10000, "<i>" * 20000 + "</b>" * 20000, "<div>" * 20000 + "</section>" * 20000,
        "<article>" * 15000 + f"<p>{PROSE}" * 500, "<div>" * 10000 + f"<p>{PROSE}</p><ul><li><a href=1>a</a></ul></div>" * 10000, f"<p class=x>{PROSE} " * 30000,
    ],
)
def test_html_time_is_linear(html):
    began = time.process_time()
    html_text.extract(html)
    assert time.process_time() - began < 6


def test_html_keeps_sibling_articles_and_loose_text():
    two = f"<main><article><p>{PROSE} A.</p></article><article><p>{PROSE} B.</p></article></main>"
    assert html_text.extract(two) == f"{PROSE} A.\n\n{PROSE} B."
    for page in (f"<main><p>{PROSE}</p><article class=comment><p>{PROSE} no</p></article></main>", f"<div><p>{PROSE}</p><div class=comment><p>{PROSE} no</p></div></div>"):
        assert html_text.extract(page) == PROSE
    assert html_text.extract(f"<div class=post><div><p>{PROSE}</p><p>{PROSE}</p></div>Loose end, said.</div>") == f"{PROSE}\n\n{PROSE}\n\nLoose end, said."


def test_html_still_cuts_marked_elements():
    marked = ["related-posts", "ad-slot-1", "sidebar-left", "share buttons", "site-header", "comment-list", "newsletter-signup box", "main-nav"]
    cut = "".join(f"<div class='{c}'>{PROSE}</div>" for c in marked)
    assert html_text.extract(f"<div>{cut}<div><p>{PROSE}</p><p>{PROSE} Last.</p></div></div>") == f"{PROSE}\n\n{PROSE} Last."
    assert html_text.extract(f"<article><header><h1>Own</h1></header><p>{PROSE}</p></article>") == f"Own\n\n{PROSE}"


@pytest.mark.parametrize(
    "name",
    [
        "id=disqus_thread", "class=commentsSection", "class=commentThread", "id=comments_v2", "class=comment-content", "class=responses", "id=discussion",
        "class=adsbygoogle", "class=advertisement-text", "class=AdUnit", "class=sidebarRight", "class=side-bar", "class=notification",
        "class=cookie-law-info-bar", "class=gdpr-message", "class=mw-editsection", "class='x1 newsLetter'",
    ],
)
def test_html_reads_names_by_their_parts(name):
    page = f"<div><div class=post>{f'<p>{PROSE}</p>' * 7}</div><div {name}>{PROSE} {PROSE}</div></div>"
    assert html_text.extract(page) == "\n\n".join([PROSE] * 7)


@pytest.mark.parametrize(
    "name",
    ["class=hidden-content", "class=mainContentHeader", "class='subscription-content'", "class=sponsored-content-body", "id=skip-to-content", "class=Header_abc1X", "class='section discussion' id=discussion"],
)
def test_html_keeps_what_only_looks_marked(name):
    assert html_text.extract(f"<div><div class=post><p>{PROSE}</p><div {name}><p>{PROSE} More.</p></div></div></div>") == f"{PROSE}\n\n{PROSE} More."


def test_html_keeps_an_articles_own_discussion():
    assert html_text.extract(f"<article><p>{PROSE}</p><div id=discussion><p>{PROSE} More.</p></div></article>") == f"{PROSE}\n\n{PROSE} More."


SHORT = "This short section has one plain paragraph of text with no comma in it at all ok."
REFERENCES = "".join(f"<li><a href={i}>Some longer title of a cited work {i}</a></li>" for i in range(4))


@pytest.mark.parametrize(
    "html,lost",
    [
        (f"<div><div>{f'<p>{PROSE}</p>' * 9}</div><div><h4>Sub</h4><p>{SHORT}</p></div></div>", ["Sub", SHORT]),
        (f"<div><div>{f'<p>{PROSE}</p>' * 9}</div><h4>Sub</h4><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table></div>", ["Sub", "one", "two", "cell"]),
        (f"<div><div>{f'<p>{PROSE}</p>' * 9}</div><div>tiny</div><div><p>{PROSE} End.</p></div></div>", ["tiny", "End."]),
        (f"<div class=row><div>{f'<p>{PROSE}</p>' * 9}</div></div><div class=row><div><p>{SHORT}</p></div></div>", [SHORT]),
        (f"<article><p>{PROSE}</p><p>{PROSE}</p></article><div><article><p>{SHORT}</p></article></div>", [SHORT]),
        (f"<article><p>{PROSE}</p><h2>References</h2><ul>{REFERENCES}</ul></article>", ["title of a cited work 3"]),
        (f"<article><p>{PROSE}</p><ol>{REFERENCES}</ol></article>", ["title of a cited work 0"]),
        (f"<article><p>{PROSE}</p><div>{REFERENCES.replace('li>', 'p>')}</div></article>", ["title of a cited work 1"]),
    ],
)
def test_html_keeps_all_parts_of_an_article(html, lost):
    links = "<div><a href=1>Home</a> <a href=2>About us</a></div>"
    text = html_text.extract(f"{links}{html}{links}")
    assert all(x in text for x in lost) and "Home" not in text


@pytest.mark.parametrize("icon", ["<svg/>", "<svg class='i' />", "<math/>", "<svg><path d=''/></svg>"])
def test_html_self_closed_icons(icon):
    assert html_text.extract(f"<article><p>{icon}{PROSE}</p>{icon}<p>{PROSE}</p></article>") == f"{PROSE}\n\n{PROSE}"


def test_html_deep_nesting_and_tables(spark):
    assert html_text.extract("<div>" * 5000 + f"<p>{PROSE}</p>") == PROSE
    rows = html_text.extract_pages(pages(spark, ROWS)).collect()
    assert len(rows) == len(ROWS) and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract_pages(pages(spark, [])).count() == 0


def plain_repeats(words, n=8):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            hit.update(range(i, i + n))
    return len(hit)


def test_quality_rules_base_counts(hostile, nothing):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(hostile).collect()}
    for i, t, *_ in hostile_rows():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        r = got[i, len(words)]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        assert r.n_repeat_words == plain_repeats(words)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0


def test_quality_rules_equal_brute_force(spark):
    """References, distances and verdicts from their definitions, over several languages and few workers' flushes."""
    rng = random.Random(12)
    words = {lang: [sentence(rng, 1) for _ in range(150)] for lang in ("en", "de", None, "xx")}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de", None]) if i > 5 else "xx"
        text = " ".join(rng.choices(words[lang], weights=range(1, 151), k=rng.choice([5, 60, 150, 400])))
        rows.append((i, text.upper() if i % 13 == 0 else " | ".join(text.split()) if i % 17 == 0 else text, lang))
    rows += [(150, None, None), (151, "", "en"), (152, rows[9][1], "en"), (152, rows[9][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    q = quality_rules

    def reference(texts):
        held = [q.classes((t or "").encode())[1] for t in texts]
        held = [x / x.sum() for x in held if x.sum() >= q.MIN_CHARS]
        bins = np.sort(np.rint(np.sqrt(np.array(held).reshape(-1, len(q.CLASSES))) * q.BINS), axis=0)
        usual = (bins[(len(held) + 1) // 2 - 1] / q.BINS) ** 2 if held else np.zeros(len(q.CLASSES))
        counts = Counter(w for t in texts for w in (t or "").lower().split())
        top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: q.COMMON]
        return len(held), usual / max(1e-9, usual.sum()), top, counts

    whole = reference([t for _, t, _ in rows])
    by = {lang: reference([t for _, t, x in rows if x == lang]) for lang in words}

    def js(p, m):
        return sum(a * math.log2(a / b) for a, b in zip(p, m, strict=True) if a > 0)

    def divergence(p, r):
        m = [(a + b) / 2 for a, b in zip(p, r, strict=True)]
        return math.sqrt(max(0, (js(p, m) + js(r, m)) / 2))

    got = {r.doc_id: r for r in q.judge(docs).collect()}
    judged = 0
    for i, text, lang in rows:
        n, usual, top, counts = by[lang] if by[lang][0] >= q.MIN_DOCS else whole
        data = (text or "").encode()
        own, split = q.classes(data)[1], (text or "").lower().split()
        d_class = divergence(own / own.sum(), usual) if own.sum() >= q.MIN_CHARS else None
        d_word = None
        if len(split) >= q.MIN_WORDS:
            total = sum(counts.values())
            r = [counts[w] / total for w in top]
            p = [split.count(w) / len(split) for w in top]
            d_word = divergence([*p, 1 - sum(p)], [*r, 1 - sum(r)])
            judged += 1
        assert got[i].class_distance == (None if d_class is None else pytest.approx(d_class, abs=1e-6))
        assert got[i].word_distance == (None if d_word is None else pytest.approx(d_word, abs=1e-6))
        fine = (d_class is None or d_class <= q.MAX_CLASS_DISTANCE[0] + q.MAX_CLASS_DISTANCE[1] / own.sum() ** 0.5) and (
            d_word is None or d_word <= q.MAX_WORD_DISTANCE[0] + q.MAX_WORD_DISTANCE[1] / len(split) ** 0.5
        )
        assert got[i].kept == (not got[i].base_failed and bool(fine))
    assert judged > 20 and by["xx"][0] < q.MIN_DOCS and len({r.kept for r in got.values()}) == 2


def test_repeated_words_random():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeated_words(words) == plain_repeats(words)


def test_distance_is_bounded_and_zero_for_equals():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.distance(p, p) == 0 and quality_rules.distance(p, q) == pytest.approx(1)


def learned(spark, module, label, good, bad, parts, part):
    from seqweave.llm.common import held_out

    rng = random.Random(9)
    rows = [(i, bad(rng) if i % 4 == 0 else good(rng), i % 4 == 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "no id", "x")], "doc_id long, text string, word string").repartition(3)
    positive = 1 if label == "toxic" else 0
    labels = spark.createDataFrame([(i, positive if b else 1 - positive) for i, _, b in rows] + [(9001, None), (None, 1)], f"doc_id long, {label} int")
    out = {r.doc_id: r for r in module.scored(docs, labels).collect()}
    assert len(out) == 803
    held = [i for i, *_ in rows if out[i].held_out]
    marks = docs.where("doc_id < 800").select("doc_id", held_out(F.col("doc_id"), parts, part).alias("m")).collect()
    assert {r.doc_id for r in marks if r.m} == set(held) and len(held) > 100
    right = sum(out[i].predicted == (positive if i % 4 == 0 else 1 - positive) for i in held)
    assert right / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert module.scored(docs.limit(0), labels).count() == 0
    assert all(r.score == 0 for r in module.scored(docs, labels.limit(0)).collect())
    return out


SYLLABLES = "ta re mi lo ka su ne vo da pi".split()


def sentence(rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_toxicity_learns_held_out(spark):
    insults = ["blockhead", "blo-ckhead", "b.l.o.c.k.h.e.a.d", "numbskull", "numb_skull", "numbskulls"]

    def bad(rng):
        words = sentence(rng).split()
        for _ in range(2):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    learned(spark, toxicity, "toxic", sentence, bad, 4, 2)


def string_map(word, number):
    """All subsequences of three letters with their decayed weights, from the definition."""
    out = {}
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, len(word)):
                letters = tuple(number(word[x]) for x in (i, j, k))
                if all(letters):
                    out[letters] = out.get(letters, 0) + toxicity.DECAY ** (k - i - 2)
    return out


def brute_margin(word, model):
    best = -math.inf
    for piece in toxicity.pieces(word):
        phi = string_map(piece, model.alphabet.number)
        norm = math.sqrt(sum(v * v for v in phi.values()))
        value = sum(v * float(model.weights[a << 12 | b << 6 | c]) for (a, b, c), v in phi.items())
        best = max(best, (value / norm if norm else 0.0) + model.bias)
    return best


def toy_model(words):
    a = toxicity.Alphabet.of(words)
    weights = np.sin(np.arange(1 << 18)).astype(np.float32)
    letters = np.arange(1 << 18)
    weights[(letters >> 12 == 0) | (letters >> 6 & 63 == 0) | (letters & 63 == 0)] = 0
    return toxicity.Model(a, weights, 0.1)


def test_toxicity_kernel_tolerates_gaps_and_insertions():
    words = ["idiot", "i.d.i.o.t", "idi0ot", "garden"]
    a = toxicity.Alphabet.of(words)
    row, sub, weight = toxicity.unit_maps(["\2" + w for w in words], a)
    phi = np.zeros((4, 1 << 18))
    phi[row, sub] = weight
    k = phi @ phi[0]
    assert k[0] == pytest.approx(1) and k[1] > 0.3 and k[2] > 0.5 and k[3] < 0.05
    row, sub, weight = toxicity.subsequences(["idiot", "i--d--i--o--t", "ixxxdxxxixxxoxxxt"], a)
    d, o, t = (a.number(c) for c in "dot")
    assert weight[sub == d << 12 | o << 6 | t].tolist() == [toxicity.DECAY**k for k in (1, 7, 10)]


def test_toxicity_scores_equal_brute_force():
    model = toy_model(["idiot", "garden", "path"])
    words = ["idiot", "a" * 70, "i--d", "", "of", "x", "ixxxdxxxixxxoxxxt", "é漢字ßabc", "path" * 20, "1234", "g-a-r-d-e-n"]
    assert model.margins(words).tolist() == pytest.approx([brute_margin(w, model) for w in words], abs=1e-4)
    texts = [None, "", " \n", "Id iot!", "you i d i o t now", "x" * 3000, " ".join(words), "a b", "(id-) - iot of the path", "of of of of of", "1 2 3", "i d. i o t"]
    texts += [" ".join(random.Random(k).choices(words, k=60)) for k in range(5)]
    scorer = toxicity.Scorer(model)
    for _ in range(2):  # the second time from the memo
        got = scorer.worst(texts)
        for text, x in zip(texts, got, strict=True):
            want = max((brute_margin(w, model) for w in toxicity.instances(text)), default=-math.inf)
            assert x == pytest.approx(want, abs=1e-4)


def test_toxicity_reads_wide_gaps_and_split_words():
    for text in ("an i--d--i--o--t he", "i**d**i**o**t", "an id iot he", "an id i ot", "(id-) iot!", "you i d i o t now"):
        assert "idiot" in toxicity.instances(text)
    assert "moron" in toxicity.instances("mo ron") and toxicity.instances("garden, path") == {"garden,", "path", "gardenpath"}
    assert list(toxicity.sentences("One two. Three\nfour? e.g.five")) == [["one", "two"], ["three"], ["four"], ["e.g.five"]]


def test_toxicity_hostile_rows(hostile, spark, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 0), (7, 0), (8, 1), (12, 0), (12, 1), (None, 1), (16, None)], "doc_id long, toxic int")
    rows = toxicity.scored(hostile, labels).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 12}) == 1
    kept = toxicity.keep_clean(hostile, labels)
    assert kept.columns == hostile.columns
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(str(r) for r in toxicity.scored(hostile, labels).where("predicted = 0").select("doc_id").collect())
    assert toxicity.keep_clean(nothing, labels).count() == 0


def test_quality_learns_held_out(spark):
    learned(spark, quality_knn, "quality", sentence, lambda rng: " | ".join(w.upper() + "!!" for w in sentence(rng).split()), 5, 0)


def test_quality_votes_equal_brute_force(spark, hostile):
    """Document frequencies, projections, exact cosines and weighted votes from their definitions, also for odd and repeated rows."""
    q = quality_knn
    rng = random.Random(8)
    rows = [(100 + i, sentence(rng) if i % 3 else sentence(rng).upper() + " | 12 | x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(hostile.select("doc_id", "text")).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(7, 1), (12, 0), (12, 1), (5, 1)], "doc_id long, quality int")
    usable = ~q.common.held_out(F.col("doc_id"), 5, 0)
    model = q.fit(docs, labels, usable)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts = {t: q.Terms().counts([t])[0].astype(float) for _, t in texts}
    held, many = q.frequencies(docs)
    assert held.tolist() == [sum(counts[t][k] > 0 for _, t in texts) for k in range(q.TERMS)] and many == sum(bool((t or "").split()) for _, t in texts)
    idf = [(math.log((many + 1) / (n + 1)) + 1) * (1 if k < q.WORDS else q.SHAPE_WEIGHT) for k, n in enumerate(held.tolist())]
    assert model.idf.tolist() == pytest.approx(idf, rel=1e-5)
    for r in q.scored(docs, labels).collect():
        for c in {tuple(counts[t]) for i, t in texts if i == r.doc_id} if [i for i, _ in texts].count(r.doc_id) == 1 else ():
            total = max(1, sum(c[: q.WORDS]))
            x = np.array([math.sqrt(n / total) * w for n, w in zip(c, idf, strict=True)]) @ model.axes.astype(float)
            x /= max(1e-9, float(np.linalg.norm(x)))
            near = sorted(((float(x @ v), float(y)) for v, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)[: q.NEIGHBOURS]
            weights = [max(k, 1e-6) ** q.POWER for k, _ in near]
            want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(c) else float(model.labels.mean())
            assert r.score == pytest.approx(want, abs=0.02) and r.predicted == int(r.score >= q.THRESHOLD)
    repeated = [r.score for r in q.scored(docs, labels).collect() if r.doc_id == 12]
    assert len(repeated) == 2 and len(set(repeated)) == 1


def test_html_sums_equal_brute_force():
    """Sums over subtrees, and what a menu is, from the blocks of each element by itself."""
    rng = random.Random(14)

    def tree(depth):
        tag = rng.choice(["div", "ul", "li", "p", "b", "section", "a href=1", "table", "h2"])
        inner = "".join(rng.choice([lambda: "some words ", lambda: tree(depth - 1) if depth else "x,", lambda: "<a href=2>go</a>"])() for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    for _ in range(150):
        root = html_text.parse("".join(tree(4) for _ in range(3)))
        stats = html_text.Stats(html_text.blocks(root), root)
        todo = [root]
        while todo:
            n = todo.pop()
            todo += [c for c in n.children if not isinstance(c, str)]
            if n.tag not in html_text.BLOCK:
                continue
            own = html_text.blocks(n)
            odd = sum(x < 0.8 * len(t) or len(t.split()) > html_text.LABEL_WORDS for _, t, x in own)
            assert stats.blocks.get(id(n), [0, 0])[:2] == [len(own), odd] or any(c.tag == "a" for c in ancestors(n))
            assert stats.texts.get(id(n), [0, 0])[0] == sum(len(t) for _, t, _ in own)


def ancestors(node):
    while node.parent is not None:
        node = node.parent
        yield node


def test_licences_match_brute_force(hostile, spark, nothing):
    filler = [f"w{i}" for i in range(400)]
    rng = random.Random(2)
    rows = []
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        words = filler[: rng.randint(0, 300)] + text.split() + filler[: rng.randint(0, 50)]
        rows.append((100 + i, " ".join(words)))
        broken = text.split()
        broken[len(broken) // 2] = "zzz"
        rows.append((200 + i, " ".join(filler[:37] + broken)))
    docs = hostile.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in license_scan.scan(docs).collect()}

    def grams(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).strip().split(" ")
        return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d in docs.collect():
        g = grams(d.text)
        for name, text in license_scan.TEMPLATES.items():
            t = grams(text)
            hits = [(p, x) for p, x in enumerate(g) if x in set(t)]
            for w in {max(0, p // len(t) - k) for p, _ in hits for k in (0, 1)}:
                inside = [(p, x) for p, x in hits if w * len(t) <= p < (w + 2) * len(t)]
                share = len({x for _, x in inside}) / len(set(t))
                if share >= 0.8:
                    old = want.get((d.doc_id, name), (0, 1 << 60))
                    want[d.doc_id, name] = (max(old[0], share), min(old[1], min(p for p, _ in inside)))
    assert got == want and (15, "mit-line") in got
    assert license_scan.scan(nothing).count() == 0
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.scan(docs, {"short": "two words"})


def test_licence_bands_are_compiled_and_whole(spark):
    """Every hash and every window's least key in each band meets the keys; texts are split once, and no least is taken by a lambda."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for n in (0, 3, 5, 9, 20, 21, 36, 37, 100, 407)], "doc_id long, text string")
    hashes = docs.select("doc_id", license_scan.hashes_of(license_scan.words_of(F.col("text"))).alias("h"))
    every = F.concat("h", license_scan.least_keys(F.col("h"), license_scan.places(F.size("h"), license_scan.PIECE), 2 * license_scan.PIECE))
    want = {(r.doc_id, str(r.key)) for r in hashes.select("doc_id", F.explode(every).alias("key")).collect()}
    keys = spark.createDataFrame([(int(k), k) for k in {k for _, k in want} | {"1", "2"}], "key long, license string")
    found = license_scan.candidates(docs, keys)
    assert {(r.doc_id, k) for r in found.collect() for k in r.licenses} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "array_min" not in plan
