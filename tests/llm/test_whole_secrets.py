"""Secrets at any place of a word, and beside each other."""

import base64
import hashlib
import re

import pytest

from sondage.llm import secret_scan


def token(k):
    raw = base64.b64encode(hashlib.sha512(str(k).encode()).digest()).decode()
    return "ghp_" + re.sub("[+/=]", "q", raw)[:36]


@pytest.fixture(scope="module")
def trees(spark):
    return secret_scan.forest(secret_scan.train(secret_scan.labelled_findings(spark)))


def values(spark, trees, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["secrets"]] for r in secret_scan.scan(rows, trees).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(rows, trees).collect()}
    return [found[i] for i in range(len(texts))], [clean[i] for i in range(len(texts))]


def test_secrets_anywhere_in_long_words(spark, trees):
    cells = ",".join(f'"field{i}":"v{i}"' for i in range(90))
    texts = [
        f'{{{cells},"token":"{token(1)}","more":1}}',
        f"说{token(2)}" + "文字" * 300,
        "文字" * 300 + token(3) + "文字" * 300,
        f"https://host/find?q={'x&y=' * 120}&token={token(4)}",
        f"row;{'12;' * 300}{token(5)};{'34;' * 300}",
    ]
    found, clean = values(spark, trees, texts)
    assert found == [[token(i)] for i in range(1, 6)]
    assert clean == [t.replace(token(i), "[SECRET]") for i, t in enumerate(texts, 1)]


def test_secrets_beside_each_other(spark, trees):
    aws = "AKIA" + "J5XKQ2M7RT4WZ8PL"
    texts = [
        f"https://host.example/services/v1/path2?token={token(1)}",
        f'{{"id":"2024-01-01-abcdef123456","token":"{token(2)}"}}',
        f"{aws} {token(3)} rest",
        f"one {aws} {token(4)} rest",
        f"{token(5)} {aws} {token(6)}",
        f"{aws}:{token(7)}",
        f"{aws}={token(8)}",
        f"{token(9)},{token(10)};{token(11)}",
    ]
    found, clean = values(spark, trees, texts)
    want = [[token(1)], [token(2)], [aws, token(3)], [aws, token(4)], [token(5), aws, token(6)], [aws, token(7)], [aws, token(8)], [token(9), token(10), token(11)]]
    assert [sorted(v) for v in found] == [sorted(v) for v in want]
    for v, t, c in zip(want, texts, clean, strict=True):
        for s in v:
            t = t.replace(s, "[SECRET]")
        assert c == t


def test_every_offset_of_a_long_unspaced_text(spark, trees):
    filler = '"k":[1,2],' * 10000
    texts = [filler[: 997 * i + i % 10] + '"' + token(100 + i) + '",' + filler[997 * i :] for i in range(100)]
    found, clean = values(spark, trees, texts)
    assert found == [[token(100 + i)] for i in range(100)]
    assert clean == [t.replace(token(100 + i), "[SECRET]") for i, t in enumerate(texts)]


def test_very_long_words_take_linear_time(spark, trees):
    blob = base64.b64encode(b"".join(hashlib.sha512(str(i).encode()).digest() for i in range(12000))).decode()[:1000000]
    lines = "\n".join(blob[i : i + 76] for i in range(0, len(blob), 76))
    several = ",".join(token(i) for i in range(2000))
    found, clean = values(spark, trees, [blob, lines, f"{blob} {token(3)} {lines}", several, '"'.join([blob[:4000]] * 3)])
    assert found[:3] == [[], [], [token(3)]] and len(found[3]) >= 1980 and found[4] == []
    assert clean[0] == blob and clean[1] == lines and clean[2] == f"{blob} [SECRET] {lines}"


def mixed(k, n):
    return re.sub("[+/=]", "q", base64.b64encode(hashlib.sha512(f"z{k}".encode()).digest()).decode())[:n]


def hexes(k, n):
    return hashlib.sha512(f"{k}".encode()).hexdigest()[:n]


#: Forms that the training rows do not have.
OTHER_SECRETS = [
    lambda k: f"clone with glpat-{mixed(k, 20)} please",
    lambda k: f"slack xoxp-{hexes(k, 12)}-{mixed(k, 24)}",
    lambda k: f"client_secret: {hexes(k, 64)}",
    lambda k: f'{{"user":"bo","auth_token":"{mixed(k, 32)}","n":3}}',
    lambda k: f"export DB_PASSWORD={mixed(k, 22)}",
    lambda k: f"https://h.example.org/a?access_token={mixed(k, 30)}&x=1",
    lambda k: f"npm_{mixed(k, 36)}",
    lambda k: f'  api_key: "{hexes(k, 32)}"',
    lambda k: f"authorization eyJhbGciOiJIUzI1NiJ9.{base64.urlsafe_b64encode(hexes(k, 50).encode()).decode().rstrip('=')}.{mixed(k, 43)} sent",
    lambda k: "config:\n-----BEGIN EC PRIVATE KEY-----\n" + "\n".join(base64.b64encode(hashlib.sha384(f"{k}{i}".encode()).digest()).decode() for i in range(k % 20 + 2)) + "\n-----END EC PRIVATE KEY-----\nend",
    lambda k: f"connect to postgres://shop:p{mixed(k, 5)}W0rd{k}x@db.internal/main now",
    lambda k: f"/cb?next=%2Fhome%26token%3Dghp_{mixed(k, 36)}%26x%3D1",
    lambda k: f"password: S3cr{mixed(k, 3)}!Pa{k}w",
    lambda k: "passwd=" + hexes(k, 18 + k % 5).translate(str.maketrans("0123456789abcdef", "hjklgfdsqwrtpzxc")) + " set",
]
OTHERS = [
    lambda k: f"image@sha256:{hexes(k, 64)}",
    lambda k: f'etag "{hexes(k, 32)}" seen',
    lambda k: f"trace {hexes(k, 8)}-{hexes(k, 4)}-4{hexes(k, 3)}-a{hexes(k, 3)}-{hexes(k, 12)} end",
    lambda k: f"see main.{hexes(k, 20)}.bundle.js loaded",
    lambda k: f"/var/lib/app{k}/releases/2024/current/index.html",
    lambda k: f"package-lock-2.{k}.0-x86_64-unknown-linux-gnu",
    lambda k: f"call +49-30-{k * 7919 % 10000000:07d}-{k * 31 % 10000:04d}",
    lambda k: f"https://cdn{k}.images-static.com/assets/img{k}/photo-large.jpg",
    lambda k: f"donaudampfschiff{k}fahrtsgesellschaft",
    lambda k: f"password=your_password_{k}_here",
    lambda k: ["the password: must have a letter", "password: string", "token = None", "secret: the gardener did it", 'api_key: ""', "passwd: files sss", "Password: forgotten?", "credentials: include", "token: undefined", "pwd: /home"][k % 10],
    lambda k: f"see http://localhost:80{k % 100:02d}/@user and git@host.org:team/app{k}.git",
    lambda k: f"-----BEGIN CERTIFICATE-----\n{base64.b64encode(hashlib.sha384(str(k).encode()).digest()).decode()}\n-----END CERTIFICATE-----",
]


def test_forms_that_were_not_learned(spark, trees):
    rows = [(i, 1, f(n)) for i, f in enumerate(OTHER_SECRETS) for n in range(100)] + [(i, 0, f(n)) for i, f in enumerate(OTHERS) for n in range(100)]
    counts = {}
    for r in secret_scan.scan(spark.createDataFrame(rows, "form int, label int, text string"), trees).collect():
        counts.setdefault((r["label"], r["form"]), []).append(len(r["secrets"]) > 0)
    assert all(sum(v) >= 95 for (label, _), v in counts.items() if label == 1), {k: sum(v) for k, v in counts.items()}
    assert all(sum(v) <= 1 for (label, _), v in counts.items() if label == 0), {k: sum(v) for k, v in counts.items()}


def test_trees_are_the_model(spark):
    """The trees written as SQL say what the model says, on findings that it was trained on and others."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    model = secret_scan.train(secret_scan.labelled_findings(spark))
    trees = secret_scan.forest(model)
    rows = secret_scan.labelled_findings(spark, 15000).select(secret_scan.features(F.col("before"), F.col("word"), F.col("after")).alias("f")).select("f.*").cache()
    table = VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(rows)
    assert len(model.trees) == len(trees)
    for one, written in zip(model.trees, trees, strict=True):
        both = one.transform(table).select("prediction", secret_scan._expression(written, F.struct(*secret_scan.FEATURES)).alias("q"))
        assert both.where("prediction != q").count() == 0 and both.select("q").distinct().count() == 2


def test_key_blocks_are_cut_out_whole(spark, trees):
    block = "-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "\n".join(base64.b64encode(hashlib.sha384(f"b{i}".encode()).digest()).decode() for i in range(30)) + "=\n-----END PRIVATE KEY-----"
    texts = [f"a {block} b", f"{block}\n{block}", "-----BEGIN PRIVATE KEY-----\n" * 3000 + "no end", "mysql://root:Xk9!pQ2zW7@h/db and again Xk9!pQ2zW7"]
    found, clean = values(spark, trees, texts)
    assert found[:3] == [[block], [block, block], []] and clean[:3] == ["a [SECRET] b", "[SECRET]\n[SECRET]", texts[2]]
    assert clean[3] == "mysql://root:[SECRET]@h/db and again Xk9!pQ2zW7"
