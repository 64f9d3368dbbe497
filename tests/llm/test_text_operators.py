import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagelens.llm import byte_bpe, common, language_id, secret_scan, token_files, topk_search, url_filter

TRICKY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\t b", "it's we'll 'tis", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x\u00a0y \u2003z", "é ñ ß 你好 🎉🎉",
    "a\x1cb \x1c c", "ab" * 3000, "1234 56 ²³", "..., !!! ###", "aaaa" * 50 + "  " * 7 + "z", "tail   ", "\u0301x", "\x85 y",
]


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.vocabulary_path())


def fuzz(n=300):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "the", "The", "'s", "é", "ü", "12", "!", "\t", "<|endoftext|>", "\u3000", "日本", "zzz", "\r\n", "_", "-", "😀", "\x1f"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(n)]


def test_bpe_equals_library(library):
    for t in TRICKY + fuzz():
        want = library.encode(t or "", add_special_tokens=False).ids
        ids = byte_bpe.encode(t, byte_bpe.vocabulary_path())
        assert ids == want, t
        bpe = byte_bpe.codec(byte_bpe.vocabulary_path())[0]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert bpe.decode(ids[1:]) == library.decode(ids[1:], skip_special_tokens=False)


def test_words_of_all_letters(library):
    """Letters and numbers that only the pattern library knows, and one in 50 of all code points."""
    plain, full = byte_bpe.patterns()
    newer = [chr(c) for c in (0x558, 0x58B, 0xC5C, 0x208F, 0x11DE0, 0x32000) if not chr(c).isalnum()]
    for ch in newer + [chr(c) for c in range(0, 0x110000, 50) if not 0xD800 <= c < 0xE000]:
        t = f"a{ch}b {ch}1{ch} '{ch}  {ch}{ch}é"
        assert full(t) == [t[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(t)], hex(ord(ch))
        if t.isascii():
            assert plain(t) == full(t)


def test_bpe_store_is_only_a_store(library):
    bpe, _ = byte_bpe.codec(byte_bpe.vocabulary_path())
    said = lambda ids: b"".join(b"%d," % i for i in ids)
    small = byte_bpe.Pieces(lambda w: said(bpe.word(w.encode())), b"".join, {t: said([i]) for t, i in bpe.special.items()}, limit=3)
    texts = fuzz(40) + ["a b a b", "x", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert small.of(t) == said(ids)
    values, index, ends = small.gathered(pa.array([*texts, None]))
    data, at = byte_bpe.joined(values, index, ends)
    assert [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)] == [*map(said, want), b""]


def test_remembered_is_bounded():
    store, asked = byte_bpe.Remembered(8), []
    for i in range(100):
        assert store.all([str(i % 10), "hot"], lambda k: (asked.append(k), k + "!")[1]) == [f"{i % 10}!", "hot!"]
        assert len(store.young) + len(store.old) <= 8
    assert asked.count("hot") == 1


def test_text_chunks():
    texts = pa.array(["a" * n for n in (5, 5, 30, 1, 1, 1, 50)] + [None])
    runs = list(byte_bpe.chunks(texts, 10))
    assert [i for i, _ in runs] == [0, *(sum(n for _, n in runs[:k]) for k in range(1, len(runs)))] and sum(n for _, n in runs) == 8 and len(runs) > 2
    assert list(byte_bpe.chunks(texts.slice(0, 0))) == []


def test_other_vocabularies(tmp_path, spark):
    """Files for which cutting is not known to be right are refused, or encoded as whole texts by the library."""
    from tokenizers import Tokenizer

    other = byte_bpe.vocabulary_path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        byte_bpe.checked(other)
    whole = token_files.Library(other)
    flat, at = whole.ids(pa.array(["Some words, here", None]), b"\2\0\0\0")
    ids = Tokenizer.from_file(other).encode("Some words, here", add_special_tokens=False).ids
    assert flat.tolist() == [*ids, 2, 2] and at.tolist() == [0, len(ids) + 1, len(ids) + 2]


def test_bpe_query(spark, library):
    out = {r.doc_id: r for r in byte_bpe.digests(docs(spark, TRICKY)).select("doc_id", "bpe.*").collect()}
    for i, t in enumerate(TRICKY):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files_round_trip(spark, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    texts = TRICKY + fuzz(200)
    token_files.write(docs(spark, texts).withColumn("tokens", F.lit(1)), path, files=3)
    rows = token_files.checksums(token_files.read(spark, path)).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(r.tokens)) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    files = sorted((tmp_path / "tokens").glob("part-*"))
    ids = [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids)
    for f in files:
        column = {c.path_in_schema: c for c in (pq.ParquetFile(f).metadata.row_group(0).column(j) for j in range(5))}
        tokens = next(c for name, c in column.items() if name.startswith("tokens"))
        assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index
        assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["doc_id"].has_column_index
    plan = token_files.read(spark, path).select("doc_id", "n_tokens").where("doc_id = 5")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("== Physical Plan ==")[1]


def test_token_files_empty(spark, tmp_path):
    token_files.write(docs(spark, ["a"]).where("false"), f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def brute_top_k(rows, k=10):
    fine = {i: [int(np.floor(1024 * float(np.float64(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in sorted(i for i in fine if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))


@pytest.mark.parametrize("kind", ["dense", "ties", "sparse", "few"])
def test_top_k_is_exact(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    n = {"few": 4}.get(kind, 700)
    rows = []
    for i in range(n):
        v = rng.normal(size=12)
        if kind == "ties":
            v = rng.integers(-1, 2, 12) * 1.0
        if kind == "sparse":
            v = v * (rng.random(12) < 0.2) + 5 * (i % 97 == 0)
        rows.append((i * 50 if kind == "few" else i, [float(x) for x in v]))
    if kind == "dense":
        rows[3], rows[4], rows[5], rows[6] = (3, None), (4, [float("nan")] * 12), (5, [1.0, None]), (6, [1.0, 2.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in topk_search.op1_topk_search(spark, f"file://{tmp_path}").orderBy("query_id", "rank").collect()]
    assert got == list(brute_top_k(rows))


def test_top_k_skips_work():
    rng = np.random.default_rng(1)
    x = np.zeros((8192, 64))
    for i in range(8192):  # sparse and positive, as terms are; the best come first
        x[i, rng.choice(64, 6, replace=False)] = rng.integers(1, 9, 6) * (20 if i < 50 else 1)
    q, work = np.zeros(64), {}
    q[:8] = [100, 30, 3, 2, 2, 1, 1, 1]
    at, best = topk_search.maxscore(np.arange(8192), topk_search.Postings(x), -1, q, 10, work)
    assert list(at) == list(np.lexsort((np.arange(8192), -(x @ q)))[:10])
    everything = int((x[:, q > 0] > 0).sum())
    assert work["postings"] < everything / 2 and work["scored"] < len(x) / 2, (work, everything)
    x[4096:] /= 100
    work = {}
    at, best = topk_search.maxscore(np.arange(8192), topk_search.Postings(x), -1, q, 10, work)
    assert work["passed"] >= 4 and list(at) == list(np.lexsort((np.arange(8192), -(x @ q)))[:10])


def test_top_k_below_zero():
    x = np.random.default_rng(2).uniform(0.1, 1, size=(3000, 6))
    at, best = topk_search.maxscore(np.arange(3000), topk_search.Postings(x), -1, -np.ones(6), 10)
    assert list(at) == list(np.lexsort((np.arange(3000), x.sum(axis=1)))[:10])


def test_top_k_of_nothing_and_of_repeated_ids(spark):
    rows = spark.createDataFrame([(100, [3, 0]), (100, [1, 1]), (1, [5, -1]), (1, [5, -1]), (2, None), (3, [])], "vec_id long, ints array<bigint>").where("ints is not null")
    got = [tuple(r) for r in topk_search.top_k(rows, rows.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 4), (100, 2, 1, 4), (100, 3, 3, 0)]
    assert topk_search.top_k(rows.where("false"), rows.where("false")).count() == 0


def test_url_rules_and_trees(spark):
    urls = [None, "", "nothing", "http://WWW.Example.com/en/1?x#y", "http://example.com/en/", "https://a.b.net/es/x", "http://xnet/es/", "http://com/", "http://a.com", "http://A.ORG?x", "x://y.net/fr/z://b", "http://\n.net/fr/1"]
    want = [("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("a.b.net", "/es/x", "net/es/"),
            ("xnet", "/es/", None), ("com", "/", "com/"), ("a.com", "", None), ("a.org", "", None), ("y.net", "/fr/z://b", "net/fr/"), ("\n.net", "/fr/1", "net/fr/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({k: F.lit(1) for k in ("h", "host", "path", "rule", "ruled", "verdict")})
    out = url_filter.filtered(df).orderBy("page_id").select("url_filter.*").collect()
    assert url_filter.filtered(df).columns == [*df.columns, "url_filter"]
    assert [(r.host, r.path, r.rule) for r in out] == want
    assert [r.verdict for r in out if r.rule] == ["allow", "block", "block", "allow", "block", "block"]
    assert {r.verdict for r in out} == {"allow", "block"}
    none = url_filter.filtered(df.where("page_id in (0, 6)")).collect()
    assert {r.url_filter.verdict for r in none} == {"allow"} and url_filter.filtered(df.where("false")).count() == 0


def test_url_trees_generalise():
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        h = f"{'x-cheap-' if bad else ''}site{rng.randint(0, 300)}.example.{'biz' if bad and rng.random() < 0.8 else 'org'}"
        p = "/" + "/".join("".join(rng.choices("0123456789" if bad else "abcdefgh", k=8)) for _ in range(3 if bad else 1))
        rows.append((f"http://{h}{p}", h, p, int(bad)))
    model = url_filter.UrlModel(rows[:2000])
    p = model.probability([r[0] for r in rows[2000:]], [r[1] for r in rows[2000:]], [r[2] for r in rows[2000:]])
    assert ((p > 0.5) == [bool(r[3]) for r in rows[2000:]]).mean() > 0.97


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


def test_secret_structures():
    import base64

    number = der(2, b"\x01" * 40)
    rsa = der(0x30, der(2, b"\0") + number * 8)
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    ec = der(0x30, der(2, b"\1") + der(4, b"k" * 32))
    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(b'{}' * 4)}.{url(b's' * 32)}"
    for text, kind in [(b64(rsa), "key64"), (b64(pkcs8), "key64"), (rsa.hex(), "keyhex"), (jwt, "jwt"), (f"-----BEGIN RSA PRIVATE KEY-----\n{b64(rsa)}\n-----END RSA PRIVATE KEY-----", "pem"), (ec.hex().upper() + "00"[:0], "keyhex")]:
        found = [k for k, _, _ in secret_scan.spans(f"é {text} tail")[1]]
        assert kind in found, (kind, found)
    for text in [b64(rsa[:-3]), b64(b"\x30\x82" + b"x" * 60), "eyJhYmNkZWZn.abcdef.abcdefghij", "3082" + "ab" * 40]:
        assert not {k for k, _, _ in secret_scan.spans(text)[1]} & {"jwt", "pem", "key64", "keyhex"}


@pytest.mark.parametrize("size", [28, *range(48, 80), 120, 127, 200, 300])
def test_secret_keys_of_any_length(size):
    import base64

    for head in (der(2, b"\1"), der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x71"))):
        key = der(0x30, head + der(4, b"k" * (size - len(head) - (2 if size - len(head) < 130 else 4))))
        text = base64.b64encode(key).decode()
        assert secret_scan.spans(f"key: {text} tail")[1] == [("key64", 5, 5 + len(text))], text[:4]


def test_secret_candidates_are_whole():
    import base64

    rng = random.Random(1)
    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).decode()
    for _ in range(20):
        key = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, rng.randbytes(40) + b"\xfb\xff\xbf" * 3 + rng.randbytes(60)))
        for text in (url(key), url(key).rstrip("="), b64(key)):
            for before, after in (("é ", " x"), ("a=", "\n"), ("_" if "+" in text else "/", "")) if "-" in text or "+" in text else ():
                assert ("key64", len(before), len(before) + len(text)) in secret_scan.spans(before + text + after)[1]
        lines = [b64(key)[i : i + 64] for i in range(0, len(b64(key)), 64)]
        for end in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n"):
            text = end.join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
            assert ("pem", 2, 2 + len(text)) in secret_scan.spans(f'"x{text}"')[1]
    for head in ('{"alg":"HS256"}', '{ "alg": "HS256"}', '{\n  "alg": "none"\n}', '{\r\n"alg":"ES256"}', ' \t{"typ":"JWT","alg":"x"}'):
        for body in ("{}", '{"sub":"1"}'):
            text = ".".join(url(x).rstrip("=") for x in (head.encode(), body.encode(), b"s" * 32))
            for before in ("", "é ", "a.b.", *(["x", "key_"] if head[0] == "{" else [])):
                assert secret_scan.spans(f"{before}{text} tail")[1] == [("jwt", len(before), len(before) + len(text))], (head, before)
    for text in ("www.some-longer-name.example.com", url(b'{"a":1}').rstrip("=") + ".abcdef.abcdefghij", url(b'["alg"]').rstrip("=") + ".abcdef.abcdefghij"):
        assert not secret_scan.spans(text)[1]


def wrap(x, width, end):
    return end.join(x[i : i + width] for i in range(0, len(x), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n", "\\r\\n", "\\\\n"])
def test_secret_keys_over_several_lines(end):
    import base64

    rng = random.Random(4)
    for size in (50, 60, 90, 150, 700):
        pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, rng.randbytes(size)))
        locked = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, b"")) + der(4, rng.randbytes(size)))
        part = lambda b: len(b).to_bytes(4, "big") + b
        ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + b"\0\0\0\1" + part(rng.randbytes(51)) + part(rng.randbytes(size))
        for key in (pkcs8, locked, ssh):
            body = wrap(base64.b64encode(key).decode(), 64, end)
            for before, after in (("é\n", f"{end}tail of it"), ("", ""), ("key: ", " x")):
                if len(body) > 64:
                    assert ("key64", len(before), len(before) + len(body)) in secret_scan.spans(before + body + after)[1], (size, before)
            for name in ("PRIVATE KEY", "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "OPENSSH PRIVATE KEY"):
                text = f"-----BEGIN {name}-----{end}{body}{end}-----END {name}-----"
                assert secret_scan.spans(f"é{text}")[1] == [("pem", 1, 1 + len(text))]
        longer = wrap(base64.b64encode(pkcs8[:-1]).decode(), 64, end)
        assert not [x for x in secret_scan.spans(longer)[1] if x[0] == "key64"]
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    for n, fine in ((64, True), (65, False)):
        text = (f"-----BEGIN RSA PRIVATE KEY-----\n{headers}" + wrap(base64.b64encode(rng.randbytes(n)).decode(), 64, "\n") + "\n-----END RSA PRIVATE KEY-----").replace("\n", end)
        assert (("pem", 0, len(text)) in secret_scan.spans(text)[1]) == fine
    lone = f"-----BEGIN PRIVATE KEY-----\nzzz {text} -----END PRIVATE KEY-----"
    assert [x[0] for x in secret_scan.spans(lone.replace(text, "-----BEGIN PRIVATE KEY-----" + base64.b64encode(pkcs8).decode()))[1] if x[0] == "pem"] == ["pem"]


def test_secret_scan_is_linear():
    import time

    def seconds(text):
        start = time.process_time()
        secret_scan.spans(text)
        return time.process_time() - start

    for unit in ("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN A PRIVATE KEY----------END B PRIVATE KEY-----", "eyJ", "eyJ9.", "a.", "AKIA", "token=", "M" + "I" * 62 + "\n"):
        n = 1_500_000 // len(unit)
        small, large = min(seconds(unit * (n // 4)) for _ in range(2)), min(seconds(unit * n) for _ in range(2))
        assert large < 8 * small + 0.5, (unit, small, large)


def brute_base(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_spans(spark):
    texts = [None, "", "secret=token:abcdefgh", "PassWord : 'abcdef'", "to\u212aen=abcdefgh", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "ab" * 12 + "g" + "0" * 23, "é token=" + "a" * 40, "api_key==abcdef", "APIKEY=x.y-z_", "ſecret=abcdefgh", "x" * 100_000 + " passwd=123456"] * 2
    out = secret_scan.scan(docs(spark, texts), redacted=True).orderBy("doc_id").select("text", "secrets.*").collect()
    for t, r in zip(texts, out, strict=True):
        want = brute_base(t)
        assert r.spans == secret_scan.joined(want) and r.base_sha256 == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert (r.redacted is None) == (not want) and (not want or not brute_base(r.redacted))


def test_language_centroids(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op5_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.lang_pred == r.lang for r in test]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 0.05 * len(got)


def test_language_edges(spark):
    texts = ["the cat and the dog sat down", "le chat et le chien sont ici", None, "", "123 !!", "Я", "x" * 200_000]
    df = docs(spark, texts, ["en", "fr", "en", None, "en", None, None]).withColumn("language", F.lit(1))
    model = language_id.fit(df)
    out = language_id.identified(df, model).orderBy("doc_id").select("language.*").collect()
    assert [r.lang_pred for r in out[:5]] == ["en", "fr", "und", "und", "und"] and [r.score for r in out[2:5]] == [0] * 3
    assert out[5].lang_pred in ("en", "fr") and out[5].rejected
    empty = language_id.fit(df.where("false"))
    assert {r.language.lang_pred for r in language_id.identified(df, empty).collect()} == {"und"}


def test_language_of_any_letter(spark):
    texts = ["\U00030000 \U00031350", "the cat and the dog", "le chat et le chien", "\u4f60\u597d", "\U0001f389 12"]
    df = docs(spark, texts, [None, "en", "fr", None, None])
    out = [r.language.lang_pred for r in language_id.identified(df, language_id.fit(df)).orderBy("doc_id").collect()]
    assert out[0] in ("en", "fr") and out[3] in ("en", "fr") and out[4] == "und"


def test_language_equals_brute_force(spark):
    """Cosines with all centroids, one text and one n-gram at a time."""
    df = common.table(spark, "/root/testdata/sf0.001", "documents").select("text", "lang")
    model = language_id.fit(df, per_language=40)
    for r in language_id.identified(df, model).limit(60).collect():
        g = language_id.grams(r.text)
        v = {i: float(np.sqrt(n)) * float(model.idf[i]) for i, n in enumerate(g) if n}
        size = sum(x * x for x in v.values()) ** 0.5
        close = [sum(x * float(c[i]) for i, x in v.items()) / size for c in model.centres]
        assert abs(r.language.score - min(1, max(0, max(close)))) < 1e-4 and close[max(j for j, x in enumerate(model.langs) if x == r.language.lang_pred)] <= max(close)
        assert max(close) - max(c for c, x in zip(close, model.langs, strict=True) if x == r.language.lang_pred) < 1e-5


def test_language_sample_is_the_first_in_hash_order(spark, monkeypatch):
    rows = [(f"text {'abcdefghij'[i % 10]} {i}", "en" if i % 5 else "fr") for i in range(3000)] * 2 + [("hot text", "en")] * 4000
    seen = {}
    monkeypatch.setattr(language_id, "Centroids", lambda texts, langs: seen.update(texts=texts, langs=langs))
    df = spark.createDataFrame(rows, "text string, lang string")
    language_id.fit(df, per_language=50)
    hashed = df.distinct().withColumn("h", F.expr("shiftrightunsigned(xxhash64(text), 11)")).collect()
    want = {lang: {r.text for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:50]} for lang in ("en", "fr")}
    got = {lang: {t for t, x in zip(seen["texts"], seen["langs"], strict=True) if x == lang} for lang in ("en", "fr")}
    assert got == want


def test_url_sample_with_one_hot_url(spark):
    df = spark.range(100_000).selectExpr("if(id % 50 = 0, concat('http://a.net/es/', id), 'http://hot.net/fr/') as url", "1 as y")
    rows = common.sampled(df, 1000, "url", 42)
    order = df.distinct().selectExpr("url", f"pmod(xxhash64(url, 42), {1 << 40}) as h").orderBy("h", "url").limit(1000).collect()
    assert [r.url for r in rows] == [r.url for r in order]
    assert len(common.sampled(df, 5000, "url", 42)) == 2001


def test_url_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in url_filter.op2_url_filter(spark, sf).collect()}
    pages = common.table(spark, sf, "pages").selectExpr("page_id", "url", f"pmod(xxhash64(url, 42), {1 << 40}) as h").collect()

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        h, p = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        fits = [(len(a + b), a + b, v) for v, a, b in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return h, p, *(max(fits)[1:] if fits else (None, None))

    of = {r.page_id: judged(r.url) for r in pages}
    train = sorted({(r.h, r.url, *of[r.page_id]) for r in pages if of[r.page_id][3]})[: url_filter.MAX_LABELLED]
    model = url_filter.UrlModel([(url, h, p, int(v == "block")) for _, url, h, p, _, v in train])
    for r in pages:
        h, p, rule, verdict = of[r.page_id]
        chance = float(model.probability([r.url], [h], [p])[0])
        x = got[r.page_id]
        assert (x.host, x.path, x.rule) == (h, p, rule) and abs(x.block_probability - chance) < 1e-5
        assert x.verdict == (verdict or ("block" if chance >= 0.5 else "allow"))


def test_operators_of_empty_tables(spark):
    none = docs(spark, ["a"]).where("false")
    assert secret_scan.scan(none).count() == byte_bpe.digests(none).count() == 0


def test_repeated_and_null_ids_in_token_files(spark, tmp_path):
    rows = [(5, "b c"), (None, "x"), (5, "a"), (5, "a"), (1, None)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", files=2)
    got = token_files.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5] and got[2].tokens == got[3].tokens != got[4].tokens
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(5)]


def test_repeated_rows_and_clashing_names(spark):
    df = docs(spark, ["secret=abcdefg", "secret=abcdefg"]).withColumns({"bpe": F.lit(1), "secrets": F.lit(2)})
    assert len({str(r.bpe) for r in byte_bpe.digests(df).collect()}) == len({str(r.secrets) for r in secret_scan.scan(df).collect()}) == 1


def test_bpe_borders_of_letters_and_points(library):
    rng, path = random.Random(8), byte_bpe.vocabulary_path()
    signs = [*"aAsrtzéßÿÀ÷×1٣.,;:!?'\"()-[]`{}~$/\\\n\t\r \x01\x0b  ǅ中ªª", "'s", "'re", " '", "\n\n", "  ", "<|endoftext|>", "word", " word", ".\n"]
    texts = ["".join(rng.choices(signs if i % 2 else signs[:40], k=rng.randrange(14))) for i in range(20000)]
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    flat, at = token_files.Library(path).ids(pa.array(texts), b"")
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == wanted
    bpe, pieces = byte_bpe.codec(path)
    values, index, ends = pieces.gathered(pa.array(texts))
    flat, at = byte_bpe.joined([v[0] for v in values], index, ends)
    assert [np.frombuffer(flat[a:b], np.uint32).tolist() for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)] == wanted


def test_bpe_pieces_meet_the_full_pattern_once_for_all_points():
    pieces, met = token_files.Library(byte_bpe.vocabulary_path()).pieces, []
    plain = pieces.plain
    pieces.plain = lambda p: met.append(p) or plain(p)
    words = ["".join(x) for x in zip("abcdefghij", "klmnopqrst", strict=True)]
    pieces.gathered(pa.array([f"x {w}. {w}, {w}; {w}! {w}?\n{w} ({w}" for w in words]))
    assert len(set(met)) <= 9, met  # signs and the text's first piece, not each word with each sign
