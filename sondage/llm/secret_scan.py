"""Secret scans with a random forest against false positives, in DataFrame expressions alone.

Candidates are long strings of key characters, values of any length that a name such as password or a URL's user
gives away, and private key blocks, in their surroundings. Each gets features: its
length, the changes between character classes along it, its entropy and shares of
character classes, how much of it common word parts cover, whether it looks like a path, a
host name or a signed token, and whether neighbouring words speak for or against a secret. A random forest
trained from labelled findings decides. The trained trees are written out as one SQL
expression over the candidates of a row, so scanning is one narrow pass without joins,
shuffles or Python; only candidates, never texts, reach the trees.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint

_KEY = r"A-Za-z0-9_\-+/=.~"
#: A name before a value that is a key itself, as in id:secret.
_OWN = r"(?=[A-Za-z_\-]*[0-9])(?:gh[pousr]_)?[A-Za-z0-9]{16,}"
#: 16 key characters or more, with a digit or 16 capitals among them.
_CORE = rf"(?=[{_KEY}]*(?:[0-9]|[A-Z]{{16}}))[{_KEY}]{{16,}}"
#: User and password of a URL, up to the at sign.
_URL = r"://[^\s:/@\x22'<>]{1,64}:[^\s/@\x22'<>]{3,128}(?=@)"
#: A whole run of such key characters, and the name it is given to. It begins where no key character stands before it, or
#: behind a percent escape.
_RUN = rf"(?:(?<![{_KEY}%])|(?<=%[0-9A-Fa-f]{{2}}))(?:(?!{_OWN}[=:])[A-Za-z0-9_\-]{{1,30}}[=:](?!/{_URL[2:]})[\x22']?)?{_CORE}"
#: A block of a private key, its dashes and all.
_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_SECRET = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|credential)s?"
_TO = r"[\x22']?[ \t]{0,3}[=:][ \t]{0,3}[\x22']?"
#: Any other value of four characters or more that is given to a name that speaks of a secret.
_TOLD = rf"{_SECRET}{_TO}(?!{_CORE})[^\s\x22'<>,;&(){{}}\[\]|\\]{{4,128}}"
_ANY = f"{_PEM}|{_URL}|{_TOLD}|{_RUN}"
_CHEAP = rf"[{_KEY}]{{16}}|{_SECRET}{_TO}|://[^\s:/@]{{1,64}}:[^\s/@]{{3}}"
_VALUE = rf"((?:[A-Za-z0-9_\-]{{1,30}}[=:])?[\x22']?(?=[{_KEY}]*[0-9A-Z])[{_KEY}]{{16,}})"

#: Word parts of ordinary names, hosts, paths and code.
PARTS = [
    "1234567890", "12345678", "123456", "12345", "1234", "123", "qwerty", "letmein", "replace", "insert", "example", "localhost", "google", "github", "mail", "http", "www", "com", "org", "net", "html", "json", "index", "image", "static", "assets", "users", "local", "share", "python", "linux", "config", "version", "release", "update", "file", "path", "test", "data", "user", "name", "time", "date", "page", "item", "node", "server", "client", "public", "private", "default", "change", "your", "here", "pass", "word", "sample", "dummy", "placeholder", "the", "and", "ing", "tion", "ent", "lib", "usr", "src", "bin", "var", "tmp", "home",
    "string", "null", "none", "true", "false", "required", "optional", "undefined", "hidden", "field", "value", "type", "input", "form", "login", "forgot", "reset", "confirm", "hash", "length", "must", "should", "enter", "new", "old", "wrong", "correct", "valid", "check", "empty", "secret", "token", "key", "number", "code", "service", "module", "system", "process", "request", "response", "handler", "manager", "factory", "model", "view", "table", "column", "error", "message", "content", "document", "window", "frame", "list", "map", "set", "get", "post", "put", "read", "write", "open", "close", "start", "stop", "first", "last", "all", "any", "not", "for", "from", "with", "this", "that", "are", "was", "has", "have", "over", "under", "long", "short", "small", "large", "red", "green", "blue", "one", "two", "three", "admin", "root", "guest", "master", "monkey", "welcome", "hello", "world", "env", "prod", "dev", "local", "main", "core", "app", "web", "api", "img", "photo", "map", "sheet", "pack", "age", "able", "ment", "ness", "ous", "ive", "er", "ed", "ly", "al", "re", "un", "in",
]
#: Neighbouring words for and against a secret.
FOR = "token|secret|passw|passwd|pwd|api.?key|apikey|auth|bearer|credential|access.?key|private.?key|aws|akia|signature"
AGAINST = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|build|version|revision|order|invoice|example|sample|dummy|placeholder|isbn|tracking|mail|http|www"
FEATURES = ["length", "changes", "entropy", "digits", "upper", "lower", "hexes", "covered", "path", "dots", "wanted", "unwanted", "assigned", "prefix", "repeats", "at_sign", "told", "form", "symbols", "consonants"]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


_NAMED = r"^(?:[A-Za-z0-9_\-]{1,30}[=:])?[\x22']?"


def _value(whole: Column) -> Column:
    """A match of _ANY without the name that it is given to; a run keeps its name if fewer than 16 characters would be left."""
    bare = _once(F.regexp_replace(whole, _NAMED, ""), lambda v: F.when(F.length(v) >= 16, v).otherwise(whole))
    block = F.startswith(whole, F.lit("-----BEGIN "))
    url = F.startswith(whole, F.lit("://"))
    told = rf"^[A-Za-z0-9_\-]{{0,20}}?{_SECRET}{_TO}"
    return F.when(block, whole).when(url, F.regexp_extract(whole, r"^://[^:]*:(.*)$", 1)).when(whole.rlike(told), F.regexp_replace(whole, told, "")).otherwise(bare)


def _name(whole: Column) -> Column:
    return F.regexp_extract(whole, r"^([A-Za-z0-9_\-]{1,30})[\x22']?[ \t]{0,3}[=:]", 1)


def features(before: Column, word: Column, after: Column) -> Column:
    """Struct of value and FEATURES of a word with one candidate between the words around it."""
    whole = F.regexp_extract(word, _VALUE, 1)
    special = F.regexp_extract(word, f"({_PEM}|{_URL}|{_TOLD})", 1)
    bare = F.regexp_replace(F.regexp_replace(word, r"^[\x22']|[\x22']$", ""), r"[\x22',;]+$", "")
    whole = F.when(special != "", special).when(whole != "", whole).otherwise(bare)
    return _features(F.when(whole == bare, bare).otherwise(_value(whole)), before, _name(whole), word, word, after)


def _features(value: Column, before: Column, name: Column, word: Column, bare: Column, after: Column) -> Column:
    """Struct of value and FEATURES: `word` is the value with what stands around it without
    blanks, `bare` that without what is cut off by quotes, commas and the like."""
    n = F.greatest(F.length(value), F.lit(1))
    near = F.lower(F.concat_ws(" ", before, name, after))
    counts = F.transform(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    columns = {
        "length": F.length(value),
        "changes": (F.regexp_count(value, F.lit(r"[a-z](?=[A-Z0-9])")) + F.regexp_count(value, F.lit(r"[A-Z](?=[a-z0-9])")) + F.regexp_count(value, F.lit(r"[0-9](?=[A-Za-z])"))) / n,
        "entropy": entropy,
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "lower": _share(value, "[a-z]"),
        "hexes": _share(value, "[0-9a-f]"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(PARTS), "")) / n,
        "path": F.when(value.rlike(r"/[a-z]{2,}|\.[a-z]{2,4}(?:$|/|:)|^[0-9]+\."), 1).otherwise(0),
        "dots": F.regexp_count(value, F.lit(r"[./\-]")),
        "wanted": F.when(near.rlike(FOR), 1).otherwise(0),
        "unwanted": F.when(near.rlike(AGAINST), 1).otherwise(0),
        "assigned": F.when(F.concat_ws(" ", before, word).rlike(r"[=:]\s*[\x22']?\S{12,}"), 1).otherwise(0),
        "prefix": F.when(value.rlike("^(?:AKIA|ASIA|gh[pousr]_|github_pat_|[sr]k[_-]|pk_live|whsec_|hf_|xox[abprs]-|glpat-|AIza|ya29|eyJ|npm_)"), 1).otherwise(0),
        "repeats": F.when(value.rlike(r"(.)\1{4}|(..)\2{3}|123456|abcdef"), 1).otherwise(0),
        "at_sign": F.when(F.instr(bare, "@") > 0, 1).otherwise(0),
        "told": F.when(F.concat_ws(" ", before, name).rlike(rf"(?:^|[^A-Za-z]){_SECRET}[\x22']?\s*[=:]?[\x22']?$"), 1).otherwise(0),
        "form": F.when(value.rlike(r"^eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}$"), 1).when(F.startswith(value, F.lit("-----BEGIN ")), 2).when(F.instr(word, "://") > 0, F.when(F.contains(word, F.concat(F.lit(":"), value, F.lit("@"))), 3).otherwise(0)).otherwise(0),
        "symbols": _share(value, r"[^A-Za-z0-9]"),
        "consonants": F.when(F.lower(value).rlike("[bcdfghjklmnpqrstvwxz]{5}"), 1).otherwise(0),
    }
    return F.struct(value.alias("value"), *[c.cast("double").alias(k) for k, c in columns.items()])


#: Characters before and after a run that are looked at, and runs that they can hold.
_NEAR, _RUNS = 300, 20


def _around(runs: Column, gaps: Column, i: Column) -> tuple[Column, Column]:
    """What stands before and after run i (from 0) of a text that is gap 0, run 0, gap 1, ..."""
    low = F.greatest(i - _RUNS, F.lit(0))
    earlier = F.zip_with(F.slice(gaps, low + 1, i - low), F.slice(runs, low + 1, i - low), lambda g, r: F.concat(F.right(g, F.lit(_NEAR)), F.right(r, F.lit(_NEAR))))
    later = F.zip_with(F.slice(runs, i + 2, F.lit(_RUNS)), F.slice(gaps, i + 3, F.lit(_RUNS)), lambda r, g: F.concat(F.left(r, F.lit(_NEAR)), F.left(g, F.lit(_NEAR))))
    before = F.concat(F.array_join(earlier, ""), F.right(F.element_at(gaps, i + 1), F.lit(_NEAR)))
    after = F.concat(F.left(F.element_at(gaps, i + 2), F.lit(_NEAR)), F.array_join(later, ""))
    return F.right(before, F.lit(_NEAR)), F.left(after, F.lit(_NEAR))


def _given(whole: Column) -> Column:
    """Array of struct(name, value) of a run: its value, and if there are equals signs in
    it, the parts between them that could be values of their own."""

    def parts(main: Column) -> Column:
        pieces = F.split(whole, "=")
        named = F.transform(pieces, lambda p, j: F.struct(F.regexp_extract(F.right(F.coalesce(F.get(pieces, j - 1), F.lit("")), F.lit(30)), r"([A-Za-z0-9_\-]{1,30})$", 1).alias("name"), p.alias("value")))
        own = F.filter(named, lambda p: (F.length(p["value"]) >= 16) & p["value"].rlike("[0-9]|[A-Z]{16}") & (p["value"] != main["value"]))
        several = (main["value"].rlike("[^=]=[^=]") | whole.rlike(f"^{_OWN}=")) & ~F.startswith(whole, F.lit("-----BEGIN "))
        return F.when(several, F.concat(F.array(main), own)).otherwise(F.array(main))

    return _once(F.struct(_name(whole).alias("name"), _value(whole).alias("value")), parts)


def _split(text: Column) -> Column:
    """Struct of a text's runs and of the gaps around them: gap 0, run 0, gap 1, ... are the text."""
    none = F.array().cast("array<string>")
    runs = F.when(text.rlike(_CHEAP), F.regexp_extract_all(text, F.lit(f"({_ANY})"), 1)).otherwise(none)
    gaps = F.when(text.rlike(_CHEAP), F.split(text, _ANY, -1)).otherwise(none)
    return F.struct(runs.alias("runs"), gaps.alias("gaps"))


def candidates(text: Column) -> Column:
    """Array of candidates of a text in order: value and features. Every run of 16 key characters with a digit or 16
    capitals among them is one, wherever it stands in a word and however long that is; so are the password
    of a URL, a block of a private key, and a value of four characters or more that is given to a name like password,
    secret or token. Each has its own
    surroundings, so that neighbours don't take them from each other: 300 characters and 20 runs on either side.
    A text is read a fixed number of times and each run's surroundings are bounded, so the work is linear in it."""

    def placed(p: Column) -> Column:
        def one(run: Column, i: Column) -> Column:
            before, after = _around(p["runs"], p["gaps"], i)
            return F.struct(run.alias("run"), before.alias("before"), after.alias("after"))

        return F.transform(p["runs"], one)

    def seen(c: Column) -> Column:
        words = F.trim(F.regexp_replace(F.regexp_extract(c["before"], r"(?<!\S)((?:\S{1,40}[ \t]{1,3}){0,2})\S{0,200}$", 1), r"\s+", " "))
        left, right = F.regexp_extract(F.right(c["before"], F.lit(40)), r"(\S*)$", 1), F.regexp_extract(F.left(c["after"], F.lit(40)), r"^(\S*)", 1)
        outer = F.regexp_extract(left, r"([A-Za-z0-9_\-]{1,30})[\x22']?[=:][\x22']?$", 1)
        end = r"[^\s\x22',;{}\[\]()<>&?|]*"
        word = lambda a, b: F.concat(a, c["run"], b)
        own = {
            "before": words,
            "word": word(left, right),
            "bare": word(F.regexp_extract(left, f"({end})$", 1), F.regexp_extract(right, f"^({end})", 1)),
            "after": F.regexp_extract(c["after"], r"^\S{0,200}[ \t]{1,3}(\S{1,40})", 1),
        }
        around = F.struct(*[v.alias(k) for k, v in own.items()], outer.alias("outer"))
        each = lambda w: F.transform(_given(c["run"]), lambda g: F.struct(g["value"].alias("value"), F.when(g["name"] != "", g["name"]).otherwise(w["outer"]).alias("name"), *[w[k].alias(k) for k in own]))
        return _once(around, each)

    each = F.flatten(_once(_split(text), lambda p: F.transform(placed(p), seen)))
    scored = F.transform(each, lambda c: _features(*[c[k] for k in ("value", "before", "name", "word", "bare", "after")]))
    return F.filter(scored, lambda c: (F.length(c["value"]) >= 16) | (c["told"] == 1) | (c["form"] == 3))


def _marked(text: Column, values: Column, mark: str) -> Column:
    """A text whose runs have each of `values` in them replaced: as a whole value, or between
    equals signs. Runs and gaps are put together again, so the text is written once."""
    m = F.lit(mark)

    def clean(run: Column) -> Column:
        between = lambda t: F.array_join(F.transform(F.split(t, "="), lambda p: F.when(F.array_contains(values, p), m).otherwise(p)), "=")
        whole = lambda v: F.when(F.array_contains(values, v), F.concat(between(F.left(run, F.length(run) - F.length(v))), m)).otherwise(between(run))
        return _once(_value(run), whole)

    put = lambda p: F.concat(p["gaps"][0], F.array_join(F.zip_with(p["runs"], F.slice(p["gaps"], F.lit(2), F.size(p["runs"])), lambda r, g: F.concat(clean(r), g)), ""))
    return F.when(F.size(values) > 0, _once(_split(text), put)).otherwise(text)


def labelled_findings(spark: SparkSession, rows: int = 13000, first: int = 0) -> DataFrame:
    """before, word, after and label of findings made by rule from a hash of their number:
    keys, tokens, passwords in use, key blocks and credentials in URLs, and hosts, paths, addresses, hashes of content,
    identifiers, placeholders, encoded contents and long names that scanners mistake for
    them. `first` is the first number."""
    n = F.col("id")
    hexes, more = F.sha2(n.cast("string"), 256), F.sha2(F.concat(n.cast("string"), F.lit("x")), 256)
    caps = F.translate(F.upper(F.base64(F.unhex(hexes))), "0189+/=", "QRSTUVW")
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, more))), "[+/=\r\n]", "q")
    content = F.regexp_replace(F.base64(F.unhex(F.concat(*[F.sha2(F.concat(n.cast("string"), F.lit(f"c{k}")), 256) for k in range(18)]))), "[\r\n]", "")
    word = F.translate(F.substring(more, 1, 9), "0123456789", "aeioutrnsl")
    pick = lambda *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(n, F.lit(7)), F.lit(len(options))) + 1).cast("int"))
    q = F.lit('"')
    dashed = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    plain = F.concat(word, F.lit(" the"))
    cases = [
        (1, plain, F.concat(F.lit("AKIA"), F.substring(caps, 1, 16))),
        (1, pick("token =", "secret =", "api_key =", "auth_token :"), F.concat(q, F.substring(hexes, 1, 40), q)),
        (1, plain, F.concat(pick("password=", "passwd=", "pwd=", "secret="), F.substring(hexes, 1, 18))),
        (1, plain, F.concat(pick("ghp_", "gho_", "ghs_"), F.substring(mixed, 1, 36))),
        (1, plain, F.concat(pick("sk_live_", "sk-", "xoxb-"), F.substring(mixed, 1, 32))),
        (1, pick("password :", "secret =", "Bearer", "access_key ="), F.substring(mixed, 1, 28)),
        (1, plain, F.concat(pick("api_key=", "token=", "apikey:"), F.substring(mixed, 3, 24))),
        (0, plain, F.concat(word, F.lit("."), F.substring(F.translate(more, "abcdef", "123456"), 1, 2), F.lit("@mail"), F.substring(F.translate(more, "abcdef", "123456"), 3, 1), F.lit(".example.com"))),
        (0, plain, F.concat(F.lit("https://www."), word, F.lit(".com/page/"), F.substring(F.translate(hexes, "abcdef", "123456"), 1, 5))),
        (0, plain, F.concat(F.lit("/usr/local/lib/python3/"), word, F.lit("/file2.py"))),
        (0, pick("commit", "sha1", "revision", "checksum:"), F.substring(hexes, 1, 40)),
        (0, pick("uuid", "id", "order", "the"), dashed),
        (0, plain, F.concat(pick("password=", "token=", "secret="), pick("your_token_here_1", "changeme12345678", "xxxxxxxxxxxxxxx1", "example_password_1", "placeholder-value-1"))),
        (0, plain, F.concat(word, F.substring(word, 2, 6), word, F.lit("2"))),
        (0, plain, F.concat(F.lit("2024-"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("-01T00:00:00.000"))),
        (0, plain, F.concat(F.substring(F.translate(hexes, "abcdef", "123456"), 1, 4), F.lit("-"), F.substring(F.translate(hexes, "abcdef", "123456"), 5, 4), F.lit("-"), F.substring(F.translate(hexes, "abcdef", "123456"), 9, 4), F.lit("-"), F.substring(F.translate(hexes, "abcdef", "123456"), 13, 4))),
        (0, plain, F.substring(F.translate(F.concat(hexes, more), "abcdef", "123456"), 1, 16)),
        (0, plain, F.concat(F.lit("release-v"), (n % 9).cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(".0-linux-x86_64.tar.gz"))),
        (0, plain, F.concat(word, F.lit("_"), word, F.lit("_v2."), F.lit("html"))),
        (0, plain, F.concat(F.upper(word), F.upper(F.substring(word, 1, 9)))),
        (1, plain, F.substring(mixed, 5, 28), pick("token", "secret.", "(password)", "apikey")),
        (0, plain, F.substring(more, 1, 40), pick("commit", "checksum", "(sha1)", "revision")),
        (0, F.lit(""), F.substring(content, 1, 76)),
        (0, plain, F.concat(pick("src=", "url(", "", "href="), F.lit("data:"), pick("image/png", "font/woff", "text/css"), F.lit(";base64,"), F.substring(content, 1, F.pmod(F.xxhash64(n), F.lit(500)).cast("int") + 150))),
        (0, pick("content:", "body", "attachment", ""), F.substring(content, 1, F.pmod(F.xxhash64(n), F.lit(500)).cast("int") + 250)),
        (1, F.lit(""), F.concat(pick("ghp_", "gho_", "sk_live_", "glpat-"), F.substring(mixed, 1, 36))),
        (1, F.lit(""), F.concat(F.lit("AKIA"), F.substring(caps, 1, 16))),
    ]
    consonants = F.translate(F.substring(more, 1, 24), "0123456789abcdef", "kdjfhsqwrtzxbvnm")
    named = pick("password:", "passwd =", "pwd:", "secret:", "token =", "api_key:")
    given = pick("password=", "passwd=", "pwd:", "secret=", "token:", 'password="', "DB_PASSWORD=")
    size = F.pmod(F.xxhash64(n, F.lit(3)), F.lit(9)).cast("int")
    short = F.concat(F.substring(mixed, 1, 4), pick("!", "@", "#", "$", "%", "-", "_"), F.substring(mixed, 7, size), F.lit("7"))
    prose = pick("required", "string", "optional", "none", "hidden", "minimum", "********", "true", "null", "confirm", "forgotten", "incorrect", "must", "undefined", "changeme", "password", "your_token", "<empty>", "Optional[str]", "the", "os.environ", "${SECRET}", "config.password", "getenv", "None", "True", "False", "NULL", "nil", "str,", "Any")
    body = F.regexp_replace(F.substring(F.concat(content, F.reverse(content), F.lower(content), content), 1, F.pmod(F.xxhash64(n), F.lit(2200)).cast("int") + 100), "(.{64})", "$1\n")
    pem = F.concat(F.lit("-----BEGIN "), pick("RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "), F.lit("PRIVATE KEY-----\n"), body, F.lit("\n-----END PRIVATE KEY-----"))
    jwt = F.concat(F.lit("eyJ"), F.substring(mixed, 1, 33), F.lit(".eyJ"), F.substring(F.translate(content, "+/=", "-_q"), 1, F.pmod(F.xxhash64(n), F.lit(120)).cast("int") + 30), F.lit("."), F.substring(mixed, 5, 43))
    url = lambda secret: F.concat(pick("postgres://", "https://", "mysql://", "redis://", "amqp://"), pick("user", "admin", word, "svc1"), F.lit(":"), secret, F.lit("@"), word, F.lit(".example.org:5432/db"))
    cases += [
        (1, named, short),
        (1, plain, F.concat(given, short)),
        (1, named, F.substring(consonants, 1, size + 12)),
        (1, plain, F.concat(given, F.substring(consonants, 1, size + 12))),
        (1, plain, F.concat(given, F.substring(mixed, 1, size + 7))),
        (1, plain, pem),
        (1, F.lit(""), pem),
        (1, plain, jwt),
        (1, pick("token:", "Bearer", "jwt =", "the"), jwt),
        (1, plain, url(short)),
        (1, plain, url(F.substring(mixed, 1, size + 7))),
        (1, plain, url(F.substring(consonants, 1, size + 8))),
        (0, named, prose),
        (0, F.lit(""), F.substring(content, 100, 76)),
        (0, F.lit(""), F.substring(content, 200, 64)),
        (0, F.lit(""), F.substring(content, 300, 60)),
        (0, plain, F.concat(given, pick("changeme12345678", "changeme123", "change-me-1234", "your-secret-12345678", "replace_me_123", "insert_token_here_1"))),
        (0, named, word),
        (0, plain, F.concat(given, prose)),
        (0, plain, F.concat(given, word)),
        (0, plain, url(pick("password", "pass", "secret", "changeme", "${PASSWORD}", "example", "guest", "root"))),
        (0, plain, F.concat(F.lit("https://"), word, F.lit(".example/services/v"), (n % 9).cast("string"), F.lit("/item"), F.substring(F.translate(more, "abcdef", "123456"), 1, 2), pick("?lang=", "?q=", "?sort=", "/?page="), word, F.reverse(word))),
        (0, pick("cache", "node", "blob", "object", "layer", "the"), F.substring(hexes, 1, 32)),
        (0, plain, F.concat(word, F.lit("-"), F.substring(hexes, 1, 20), pick(".min.js", ".chunk.css", ".map", ".svg"))),
        (0, plain, F.concat(F.lit("com.example."), word, F.lit("."), F.substring(word, 2, 6), F.lit(".impl2.Handler"))),
    ]
    kind = F.pmod(n, F.lit(len(cases)))
    case = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), b.alias("before"), w.alias("word"), (a[0] if a else F.lit("")).alias("after")) for y, b, w, *a in cases]), (kind + 1).cast("int"))
    return spark.range(first, first + rows, 1, 4).select(case.alias("c")).select("c.before", "c.word", "c.after", "c.label")


def train(findings: DataFrame, trees: int = 15, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, word, after, label 0 or 1)."""
    rows = findings.select("label", features(F.col("before"), F.col("word"), F.col("after")).alias("f")).select(F.col("label").cast("double").alias("label"), *[F.col("f")[k].alias(k) for k in FEATURES])
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(checkpoint(rows))  # read several times
    # half of the features at each node: a few say all of some forms
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=seed).fit(table)


_IF = re.compile(r"^(\s*)If \(feature (\d+) (<=|>) (\S+)\)")


def _tree(lines: list[str]) -> tuple[tuple, list[str]]:
    """(feature, threshold, left, right) or (prediction,) of a printed tree."""
    head = lines[0]
    if m := re.match(r"^\s*Predict: (\S+)", head):
        return (float(m[1]),), lines[1:]
    m = _IF.match(head)
    left, rest = _tree(lines[1:])
    right, rest = _tree(rest[1:])  # the line Else
    return (int(m[2]), float(m[4]), left, right), rest


def _expression(tree: tuple, c: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    feature, threshold, left, right = tree
    if left == right:
        return _expression(left, c)
    return F.when(c[FEATURES[feature]] <= threshold, _expression(left, c)).otherwise(_expression(right, c))


def forest(model: RandomForestClassificationModel) -> list[tuple]:
    return [_tree([x for x in t.toDebugString.split("\n")[1:] if x.strip()])[0] for t in model.trees]


def scan(documents: DataFrame, trees: list[tuple], threshold: float = 0.5) -> DataFrame:
    """`documents` with `secrets`: array of struct(value, score) in the order of the text, for
    candidates to which a share over `threshold` of the trees says secret.

    Null and empty texts have none. The column is replaced if there is one of that name;
    others pass through; repeated rows give equal results, and an empty table gives no rows.
    Very long texts are read as a whole, in time linear in their length; a value may have any
    length. A value that stands in a text several times is found each time.
    """
    score = lambda c: sum((_expression(t, c) for t in trees), F.lit(0.0)) / float(len(trees))
    scored = F.transform(candidates(F.col("text")), lambda c: F.struct(c["value"].alias("value"), score(c).alias("score")))
    return documents.withColumn("secrets", F.coalesce(F.filter(scored, lambda s: s["score"] > threshold), F.array().cast("array<struct<value:string,score:double>>")))


def redact(documents: DataFrame, trees: list[tuple], mark: str = "[SECRET]") -> DataFrame:
    """`documents`, with the same columns, with every secret's value replaced in `text`.

    A value that is a secret in one place of a text is replaced wherever it is a value in it.
    Null and empty texts stay as they are; texts of any length are read as a whole.
    """
    rest = F.struct(F.lit(0).alias("text"), *[F.col(c) for c in documents.columns if c != "text"]).alias("_row")
    found = scan(documents.select("text", rest), trees)
    values = F.array_distinct(F.transform("secrets", lambda s: s["value"]))
    clean = F.transform(F.array(values), lambda v: _marked(F.col("text"), v, mark))[0]
    return found.select(*[clean.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in documents.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, one row for each."""
    trees = forest(train(labelled_findings(spark)))
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), trees)
    return found.select("doc_id", F.posexplode("secrets").alias("place", "s")).select("doc_id", "place", F.length("s.value").alias("length"), F.sha2("s.value", 256).alias("value_sha256"), F.round("s.score", 6).alias("score"))
