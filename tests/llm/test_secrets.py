import hashlib
import random
import re
import string

import numpy as np

from rootspan.llm import secrets

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "token", "token=", 'PassWord" : \'abcdefghijkl', "é token = abcdefghijk", "ééé api_key=ABCDEFGHIJKLMN apikey:abc.def_ghi/jkl", "AKIA1234567890ABCD AKIAABC AKIA" + "Z" * 14, "AKIA" * 6,
    "0123456789abcdef0123 é 0123456789abcde 0123456789ABCDEF", "secret=token=password=aaaaaaaaaaaaaaaa", "x" * 5000 + " token: " + "f" * 90000, "token  =  'abcabcabcabc", "tokentoken=abcdefabcdef12",
]


def slow(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)], line


def test_given_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, None, 1), (0, texts[0], 1)], "doc_id long, text string, spans int")
    net = secrets.fit_network(docs)
    assert secrets.LEAST_CHANCE <= net.threshold <= 1
    rows = secrets.scan_secrets(df, net).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        counts, line = slow(texts.get(r.doc_id))
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert ",".join(s for s in spans if not s.startswith("key:")) == line
        assert [s.split(":")[1] for s in spans] == sorted((s.split(":")[1] for s in spans), key=int)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_network_on_held_out_keys(spark):
    """Keys and words that the training never saw."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = secrets.fit_network(docs)
    rng = random.Random(9)
    prose = " ".join(r.text for r in docs.limit(20).collect() if r.text)

    def placed(x):
        at = prose.find(" ", rng.randrange(len(prose) - 100))
        data = (prose[max(0, at - 200) : at] + " " + x + prose[at : at + 200]).encode()
        start = data.find(x.encode())
        return secrets.window(data, start, start + len(x))

    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 32, 40]))) for _ in range(100)]
    words = ["".join(rng.choice(["th", "er", "on", "an", "ing", "tion", "ble", "re"]) for _ in range(rng.randrange(6, 11))) for _ in range(100)]
    hit = net.chance(np.array([placed(k) for k in keys])) >= net.threshold
    miss = net.chance(np.array([placed(w) for w in words])) >= net.threshold
    assert hit.mean() >= 0.95 and miss.mean() <= 0.05
    mixed = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    data = f"the value {mixed} here".encode()
    assert secrets.further_candidates(data, []) == [(10, 3, 50)]


def test_no_labels_adds_nothing():
    net = secrets.train(np.zeros((3, secrets.WINDOW), dtype=np.int64), np.array([True, False, False]))
    assert secrets.all_findings(b"xyz123" * 10 + b" plain", net) == []


def test_masking(spark):
    df = spark.createDataFrame([(1, "é token = \"abcdefabcdef1234abcd\" x", "en", 0), (2, None, "en", 7), (3, "plain", "en", 5), (4, "", None, 0)], "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.mask_secrets(df).collect()}
    assert out == {1: ('é token = "<secret>" x', 22), 2: (None, None), 3: ("plain", 5), 4: ("", 0)}
    assert secrets.mask_secrets(df).columns == df.columns


def test_candidates():
    def cut(text):
        data = text.encode()
        return {data[a:b].decode() for a, _, b in secrets.further_candidates(data, secrets.base_findings(data))}

    key = "aB3" * 8
    assert cut(f"x {key}, y") == {key}
    assert cut("pass Tr0ub4dor&3x.") == {"Tr0ub4dor&3x"}
    assert cut("k" * 32 + " and " + "word" * 5) == {"k" * 32}
    assert cut("see https://e.com/p/550e8400-e29b-41d4-a716-446655440000/x") == {"550e8400-e29b-41d4-a716-446655440000"}
    assert cut("on 2024-01-02T10:00:00Z v1.22.333 mail me@e2.com line-12 12,345,678") == set()
    assert cut("0123456789abcdef") == set() and cut("Zz9" * 9 + "0123456789abcdef") == {"Zz9" * 9 + "0123456789abcdef"}


def test_long_candidates_are_read_to_their_end():
    data = b"x" * 50 + b"a1" * 200 + b"y" * 9
    views = secrets.windows(data, 50, 450)
    assert len(views) > 5 and all(v.shape == (secrets.WINDOW,) for v in views)
    assert (views[-1] == secrets.window(data, 450 - 2 * secrets.WINDOW // 3, 450)).all()


def test_precision_and_recall_of_planted_keys(spark):
    """Keys and passwords that no pattern finds, and what looks alike, planted into prose; the network is trained on other documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = secrets.fit_network(docs.where("doc_id % 2 = 0"))
    prose = [r.text for r in docs.where("doc_id % 2 = 1 and n_chars > 3000").limit(40).collect()]
    rng, letters = random.Random(31), string.ascii_letters

    def found(x):
        text = rng.choice(prose)
        at = text.find(" ", rng.randrange(len(text) - 800))
        data = f"{text[:at]} {x}{text[at:]}".encode()
        a = data.find(x.encode())
        return any(k == 3 and s < a + len(x) and a < e for s, k, e in secrets.all_findings(data, net))

    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    keys = [lambda: pick(letters + string.digits, 40), lambda: pick(letters, 32), lambda: pick(letters + string.digits + "+/", 43) + "=", lambda: pick(letters, 7) + pick(string.digits, 1) + pick("!@#$&", 1) + pick(letters, 2)]
    plain = [lambda: pick(["th", "er", "on", "ing", "tion", "ble"], 14), lambda: f"2024-0{rng.randrange(1, 9)}-11T0{rng.randrange(9)}:00:00Z", lambda: f"https://e.com/news/page-{rng.randrange(9999)}/view", lambda: f"worker_node_{rng.randrange(10**6)}", lambda: f"getUserById{rng.randrange(99)}"]
    hit = [found(make()) for make in keys for _ in range(60)]
    miss = [found(make()) for make in plain for _ in range(60)]
    recall, precision = sum(hit) / len(hit), sum(hit) / max(1, sum(hit) + sum(miss))
    assert recall >= 0.95 and precision >= 0.97


def test_masking_malformed_utf8(spark):
    rows = [(1, bytearray(b"a\xff token=abcdefabcdef1234 b")), (2, bytearray(b"\xc3("))]
    df = spark.createDataFrame(rows, "doc_id long, text binary").repartition(2).selectExpr("doc_id", "cast(text as string) text", "1 as spans")
    got = {r.doc_id: r.text for r in secrets.mask_secrets(df, secrets.train(np.zeros((3, secrets.WINDOW), dtype=np.int64), np.array([True, False, False]))).collect()}
    assert got == {1: "a\ufffd token=<secret> b", 2: "\ufffd("}
