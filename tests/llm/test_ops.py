import collections
import functools
import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from genoloom.llm import html, langid, lmscore, media, mixing, quality, sharding, simhash, suffix_dedup
from genoloom.llm.common import components
from genoloom.llm.decontam import contamination, decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choice(words, 150)) for _ in range(25)]
    out += [out[0], out[1] + " end", out[2][:500] + " zz " + out[3][200:900], "", None, "  \n", "short", "Ünï cödé " * 60, "aaaa" * 300, "Hello. " * 9, out[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lpt_shards(spark, docs, texts):
    for grain in (16384, 4):
        got = sharding.shard(docs, 4, grain).collect()
        assert len(got) == len(texts)
        for k in range(4):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert len({r.shard for r in got if texts[r.doc_id] == texts[0]}) == 1
        assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 for r in got)
    loads = sharding.lpt([(i, s) for i, s in enumerate([7, 6, 5, 4, 3, 3])], 2)
    assert sorted(sum(s for i, s in enumerate([7, 6, 5, 4, 3, 3]) if loads[i] == k) for k in (0, 1)) == [14, 14]
    assert sharding.shard(empty(spark)).count() == 0


def brute_repeats(texts, n):
    seen = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                hit[i : i + n] = True
        yield len(t), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.view(np.int8)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup_is_brute_force(docs, texts, group):
    want = list(brute_repeats([(t or "").encode() for t in texts], 100))
    got = suffix_dedup.remove_repeats(docs, 100, group, with_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_suffix_dedup_of_long_texts(spark):
    """The default 400 bytes, texts over the 1 MiB that are hashed at once, copies of a text that shares a passage with others, null ids."""
    rng = np.random.default_rng(6)
    long = bytearray(rng.integers(97, 123, 2_300_000, dtype=np.uint8).tobytes())
    passage = bytes(rng.integers(97, 123, 1_500, dtype=np.uint8))
    for at in ((1 << 20) - 700, 2_100_000):
        long[at : at + 1_500] = passage
    morse = np.array([x.bit_count() & 1 for x in range(4096)], np.uint8)
    raw = [bytes(long), b"x" + passage[:399], passage[100:500] + b"y", passage[1000:], b"", bytes(97 + morse), bytes(98 - morse), b"z" * 401]
    raw += [b"some text of its own " * 9 + passage[:700]] * 40 + [bytes(long)[5_000:9_000]]
    seen = collections.Counter(hash(t[i : i + 400]) for t in raw for i in range(len(t) - 399))
    frame = spark.createDataFrame([(i if i % 9 else None, t.decode(), "x") for i, t in enumerate(raw)], "doc_id long, text string, spans string")
    want = []
    for i, t in enumerate(raw):
        hit = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                hit[k] += 1
                hit[k + 400] -= 1
        hit = np.cumsum(hit)[:-1] > 0
        want.append((str(i if i % 9 else None), len(t), int(hit.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, with_bytes=False).collect()]
    assert sorted(got) == sorted(want)


def test_hashes_of_structured_strings_differ():
    """Thue-Morse strings and their complements collide under any polynomial of single bytes modulo 2^64."""
    morse = np.array([x.bit_count() & 1 for x in range(1 << 13)], np.uint8)
    for n in (512, 1024, 4096):
        a, b = (suffix_dedup.Rolling(x[:n]).every(n)[0] for x in (97 + morse, 98 - morse))
        assert a != b and (int(a) ^ int(b)).bit_count() > 8


def test_suffix_dedup_of_no_rows(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_quality_learns_a_pairwise_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.Gam(pair_rounds=60).fit(x[:2000], y[:2000])
    assert ((gam.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_quality_of_odd_rows(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels, "quality", F.col("doc_id") > 2).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, labels.where("false"), "quality", F.lit(True)).collect()} == {0.5}


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(docs, texts):
    prints = [brute_print(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == group
    assert simhash.deduplicate(docs).count() == len(set(group))


@pytest.mark.parametrize("most_run", [1 << 18, 8])
def test_golay_keys_lose_no_link(spark, most_run):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, e, replace=False)) for b in base for e in (1, 2, 3, 4, 4)]
    fps = sorted({int(b) for b in base} | set(near))
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in components(simhash.links(frame, 4, most_run)).collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                assert roots[a] == roots[b]


def test_html():
    page = """<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; more</h1><p>One  <b>two</b>,
    three &lt;x&gt;.<p>Four.<div class="comments"><p>Not me, no.</p></div></article><aside>side</aside><footer>end</footer></body></html>"""
    assert html.main_text(page) == "Head & more\nOne two, three <x>.\nFour."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""


ARTICLE = "Long text, with marks. And more of it, here and there."
PAGES = {
    "hello world": "hello world",
    "<p>a, b.</p> tail text": "a, b.\ntail text",
    "<a <a <a": "<a <a <a",
    "x < y & z": "x < y & z",
    "<html><head><title>T</title><body><p>Some words here, and there.</p>": "Some words here, and there.",
    "<p>One, two.</p><select><option>x<p>Three, four.</p>": "One, two.\nThree, four.",
    f'<div class="overflow-hidden"><p>{ARTICLE}</p></div>': ARTICLE,
    f'<article><p>{ARTICLE}</p><div id="discussion"><p>We discuss, at length, this.</p></div><div id="related-work"><p>Others, too, did so.</p></div><div id="navier-stokes"><p>As ever, it is hard.</p></div></article>': f"{ARTICLE}\nWe discuss, at length, this.\nOthers, too, did so.\nAs ever, it is hard.",
    f'<body><nav><a>x</a></nav><article><div class="post-header"><h1>Title</h1></div><div class="body"><p>{ARTICLE}</p><p>{ARTICLE}</p></div></article></body>': f"Title\n{ARTICLE}\n{ARTICLE}",
    "<article><p>Press <button>Go</button> to start, or not.</p></article>": "Press Go to start, or not.",
    f'<div class="page with-sidebar"><article><p>{ARTICLE}</p></article><div class="sidebar"><p>Not this, no.</p></div></div>': ARTICLE,
    f'<div class="no-sidebar search-results layout menu-open"><article><p>{ARTICLE}</p></article></div>': ARTICLE,
    "<nav><ul><li><a href=x>one</a><li><a>two</a></ul></nav>": "",
    '<p aria-hidden="false">Yes, here.</p><p hidden>Not, here.</p><p style="display: none">Nor, here.</p>': "Yes, here.",
    f"<article><p>{ARTICLE}</p><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>": f"{ARTICLE}\na\nb\nc\nx\ny",
    f"<article><p>{ARTICLE}</p><aside><p>Aside, from this.</p></aside><form><p>Your mail, please.</p></form></article>": ARTICLE,
    f"<article><p>{ARTICLE}<br>next &lt;line&gt; &amp;amp; \u0130</p><script>var a = '<p>';</script><style>p {{}}</style><!-- no --></article>": f"{ARTICLE} next <line> &amp; \u0130",
    f"<div><p><b>{ARTICLE}<br><p>Unclosed, it is.</p></div>": f"{ARTICLE}\nUnclosed, it is.",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_html_pages(page):
    assert html.main_text(page) == PAGES[page]


def test_html_threshold_chooses():
    """With the threshold off, what the scores drop is there."""
    page = f"<body><div><a>home</a> <a>news</a></div><div><span>Buy now.</span></div><section>{'<p>' + ARTICLE * 5 + '</p>'}{'<p>' + ARTICLE * 4 + '</p>'}</section><div>Short line</div></body>"
    assert html.main_text(page) == "\n".join([ARTICLE * 5, ARTICLE * 4])
    assert html.main_text(page, 0).split("\n") == ["home news", "Buy now.", ARTICLE * 5, ARTICLE * 4, "Short line"]


def test_html_of_generated_pages():
    """Articles between all that isn't one, by elements or by names, are found whole."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(" ".join(rng.choice("some words of a kind that are read".split(), int(rng.integers(4, 12)))) + "." for _ in range(n))
    for k in range(60):
        paragraphs = [say(int(rng.integers(1, 7))) for _ in range(int(rng.integers(4, 9)))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        nav, foot, ad, comments = (("nav", "footer", "aside", "aside") if k % 2 else ("div class=site-nav", "div class=site-footer", "div class='ad'", "div id=comments"))
        close = lambda x: "</" + x.split()[0] + ">"
        links = "".join(f"<li><a href=x>{say(1)}</a></li>" for _ in range(6))
        page = f"<html><head><title>{say(1)}</title></head><body><{nav}><ul>{links}</ul>{close(nav)}<{ad}>{say(2)}{close(ad)}<div class=z>{body}</div><{comments}><p>{say(2)}</p><p>{say(1)}</p>{close(comments)}<{foot}>{say(1)}{close(foot)}</body></html>"
        assert html.main_text(page) == "\n".join(paragraphs)


@pytest.mark.parametrize("part", ["<div>", "<div><p>a", "<b>", "</p><p><i>", "<select>", "<textarea>", "<div a='", '<a "', "<title>", "<!--", "<li><p>", "<td>"])
def test_html_is_linear(part):
    """Ten times the page takes far less than a hundred times as long."""
    def took(n):
        began = time.perf_counter()
        html.main_text(part * n + "x")
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 40 * max(took(2_000), 0.01)


def test_html_table(spark):
    rows = [(1, "u", "<p>A, b.</p>", "k"), (1, "u", "<p>A, b.</p>", "k"), (None, None, None, None), (2, "v", "", "k"), (3, "w", "<div><p>" + "word, " * 200_000 + "</p></div>", "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html.extract(frame).collect())
    long = ("word, " * 200_000).strip()
    assert got == sorted([("1", "u", "A, b.", 5)] * 2 + [("None", None, "", 0), ("2", "v", "", 0), ("3", "w", long, len(long))])
    assert html.extract(frame.where("false")).count() == 0


def test_language_id(spark):
    one, two = "the cat sat on the mat and then the dog ran off ", "der hund lief schnell und die katze sass auf dem dach "
    rows = [(i, (one if i % 2 else two) * (1 + i % 7), "en" if i % 2 else "de", "s", 1) for i in range(40)] + [(90, None, None, None, None), (91, "123 !", "en", "s", 1), (92, "", "de", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict(frame, langid.fit(frame, F.col("doc_id") < 20)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3
    assert langid.predict(empty(spark), langid.fit(empty(spark), F.lit(True))).count() == 0


def test_media_round_trip(docs, texts):
    for r in media.media_columns(docs).collect():
        raw = media.pad((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest()) and len(raw) % 192 == 0
    frames = np.concatenate([np.full((20, 12, 16), 10, np.uint8), np.full((20, 12, 16), 200, np.uint8)])
    got = media.clips(media.write_avi(media.encode_frames(frames)))
    assert [c[2:] for c in got] == [(0, 20), (20, 40)]


def test_language_model_base(spark, docs, texts):
    got = {r.doc_id: r for r in lmscore.score(docs, F.col("doc_id") % 7 != 2, depth=3).collect()}
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = collections.Counter(x for i, w in enumerate(words) if i % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in enumerate(words):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(got[i].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
    assert lmscore.score(empty(spark), F.lit(True)).count() == 0
    assert all(abs(r.score - len(((texts[r.doc_id] or "") + "x").encode()) * 8 * math.log10(0.5)) < 1e-3 and r.train_tokens == 0 for r in lmscore.score(docs, F.lit(False)).collect())


class NaiveTree:
    """Context-tree weighting one node at a time."""

    def __init__(self, depth):
        self.depth, self.count, self.children = depth, {}, collections.defaultdict(set)

    def steps(self, text):
        past = [0] * self.depth
        for y in [*text, 0]:
            for k in range(8):
                yield tuple(past), (1 << k) | (y >> (8 - k)), y >> (7 - k) & 1
            past = [*past, y][len(past) + 1 - self.depth :] if self.depth else []

    def learn(self, text):
        for past, node, bit in self.steps(text):
            for d in range(self.depth + 1):
                at = past[self.depth - d :], node
                self.count.setdefault(at, [0, 0])[bit] += 1
                if d:
                    self.children[at[0][1:], node].add(at)

    def own(self, at):
        a, b = self.count[at]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.lru_cache(None)  # noqa: B019
    def weighted(self, at):
        if len(at[0]) == self.depth:
            return self.own(at)
        below = sum(self.weighted(x) for x in self.children[at])
        return np.logaddexp(self.own(at), below) - math.log(2)

    def one(self, past, node):
        p, rest, mass = 0.5, 0.0, 1.0
        for d in range(self.depth + 1):
            at = past[self.depth - d :], node
            if at not in self.count:
                break
            a, b = self.count[at]
            kt = (b + 0.5) / (a + b + 1)
            p = rest + mass * kt
            if d < self.depth:
                below = sum(self.weighted(x) for x in self.children[at])
                w = 1 / (1 + math.exp(min(700, below - self.own(at))))
                rest, mass = rest + mass * w * kt, mass * (1 - w)
        return p

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for past, node, bit in self.steps(text) for p in [self.one(past, node)])


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 6])
def test_language_model_is_naive_context_tree_weighting(spark, docs, texts, depth, monkeypatch):
    monkeypatch.setattr(lmscore, "LEAST_BUCKETS", 16)
    tree, raw = NaiveTree(depth), [(t or "").encode().lower() for t in texts]
    for i, t in enumerate(raw):
        if i % 7 != 2:
            tree.learn(t)
    some = docs.withColumns({"th": F.lit(1), "learn": F.lit("x"), "block": F.lit(None).cast("string")}).unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    got = {r.doc_id: r.score for r in lmscore.score(some, F.col("doc_id") % 7 != 2, depth=depth).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(raw):
        assert abs(got[i] - tree.score(t)) < 1e-4 * max(1, abs(got[i])), i


def test_language_model_of_cut_runs(monkeypatch):
    """The ordered stream in the smallest runs gives what one run gives."""
    grams, n = np.unique(lmscore._stream([b"abracadabra" * 3, b"banana band", b"cab"], 4)[0], return_counts=True)
    batches = lambda k: [pa.RecordBatch.from_arrays([pa.array(grams[i : i + k].view(np.int64)), pa.array(n[i : i + k])], ["key", "n"]) for i in range(0, len(grams), k)]

    def sums():
        out = collections.defaultdict(float)
        for batch in lmscore._rising(2, 4)(iter(batches(3))):
            for at, *rest in zip(*(batch.column(c).to_pylist() for c in ("at", "zeros", "ones", "below")), strict=True):
                for k, x in enumerate(rest):
                    out[at, k] += x
        return out

    whole = sums()
    monkeypatch.setattr(lmscore, "RUN", 1)
    cut = sums()
    assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-9 for k in whole)


def test_language_model_of_large_blocks(spark, docs, texts, monkeypatch):
    """Blocks of one text each, and null ids and repeated rows, change no score."""
    one = {r.doc_id: r.score for r in lmscore.score(docs, F.col("doc_id") < 20, depth=4).collect()}
    both = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    more = lmscore.score(both, F.coalesce(F.col("doc_id") < 20, F.lit(False)), depth=4).collect()
    assert len(more) == 3 * len(texts) and len({r.train_tokens for r in more}) == 1
    assert sum(r.doc_id is None for r in more) == len(texts) and all(r.score < 0 for r in more) and len(one) == len(texts)


def test_decontamination(spark, texts):
    words = (texts[0] or "").split()
    items = [(1, " ".join(words[5:20])), (2, "Hello hello!"), (3, ""), (None, " ".join(words[30:42])), (4, None), (5, " ".join(words[30:42]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = table(spark, texts).select("doc_id", "text", F.lit(1).alias("spans"))
    for size in (1 << 17, 8):
        got = {r["c0"]: r for r in contamination(frame.toDF("c0", "text", "c2"), bench, 10, size).collect()}
        assert got[0].n_hit == 27 and got[0].n_items == 3 and got[0].items_sha256 == hashlib.sha256(b"1,5,null").hexdigest()
        assert got[34].n_hit == 9 and got[29].n_words == 0
    kept = decontaminate(frame, bench)
    assert kept.columns == ["doc_id", "text", "spans"] and 0 not in {r.doc_id for r in kept.collect()}
    assert contamination(empty(spark), bench).count() == 0
    assert contamination(table(spark, texts), bench.where("false")).where("n_hit > 0").count() == 0


def test_mixing(spark, docs, texts):
    rows, slots, _ = mixing.mix(docs, block=16)
    got = rows.collect()
    assert len(got) == len(texts) and all(r.taken <= 3 * r.size for r in got)
    for s in {r.src for r in got}:
        own = [r for r in got if r.src == s]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].target <= 3 * own[0].source_size
    assert abs(sum({r.src: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(docs, block=16)[0].collect()}
    assert slots.count() > 0 and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty(spark))[0].count() == 0
