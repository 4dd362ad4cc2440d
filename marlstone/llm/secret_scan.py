"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 characters of keys and tokens that has both a letter and a digit, within one word; a name and an
equals sign before it don't belong to it, up to two at its end (padding) do. So is, from 8 characters on and of whatever kind, what follows a telling name and a
colon or equals sign (``password: ...``, in the languages of the tables), and the password of a URL, from 6 characters on. Its features are its length and character mix, how often
neighbouring characters change class and how often consonants and vowels take turns, how much of it dictionary words
cover, its document's path, and the words beside it. The forest is trained on labelled findings: rows (value, before, after, path, label), of
which at most ``most_rows`` are taken. Without any, those of ``example_findings`` are used, which are made by rule.

Everything is DataFrame expressions and Spark's own random forest. Texts without a candidate are let go by one pattern before they are split
into words.

Edge cases: null and empty texts have no candidate; a null path is an empty one; a candidate that occurs again is a finding each
time, candidates of one word have the text between them as their context; rows with the same id are scanned each; long texts are read whole; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.text import words

_RUN = r"[A-Za-z0-9+/_\-]"
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z+/_\-]*[0-9])(?=[0-9+/_\-]*[A-Za-z]){_RUN}{{16,}}+={{0,2}}+"
#: Names before a colon or equals sign that tell a secret, what may follow, and where a URL has its password.
NAMES = "passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|kennwort|contrase.a|clave|mot.de.passe"
TOLD = rf"(?i)(?:{NAMES})\w*[\"'\]]?\s*(?::=|=>|[:=])\s*[\"']?([^\s\"'`,;<>(){{}}\[\]]{{8,}})"
IN_URL = r"://[^\s:/@]{1,64}:([^\s:/@]{6,})@"
#: Words that names are made of, and words that tell secrets, other digests and stand-ins apart.
DICTIONARY = "account address admin app base build cache class client code config content count create data date default demo delete dev doc example feature field file first folder form get group handler image index info input item key last level line link list load local main make manager message model module name node number object option order output page part path place port prod project property query read release report request resource response result root sample save script search server service session set setting size source start state status string style system table target task template test text time title token type update upload user util value version view web word work write your".split()
TELLING = "token|secret|passw|pwd|api.?key|credential|auth|bearer|private.?key|access.?key"
OTHER = "commit|revision|checksum|sha1|sha256|md5|digest|etag|uuid|guid|version|build|blob|tree"
STAND_IN = "example|sample|dummy|placeholder|changeme|your|fake|test|xxxx"
FEATURES = ["length", "changes", "digits", "uppers", "symbols", "hex", "distinct", "turns", "covered", "path_test", "told", "assigned", "other", "stand_in"]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def with_features(findings: DataFrame) -> DataFrame:
    """Adds FEATURES to rows (value, before, after, path)."""
    v, path = F.col("value"), F.lower(F.coalesce("path", F.lit("")))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    lower = F.lower(v)
    flag = lambda c: c.cast("double")
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=\-])(?=[^+/_=\-])"
    longest = sorted(DICTIONARY, key=lambda w: (-len(w), w))
    return findings.withColumns(
        {
            "length": F.length(v).cast("double"),
            "changes": _share(v, changes),
            "digits": _share(v, "[0-9]"),
            "uppers": _share(v, "[A-Z]"),
            "symbols": _share(v, r"[+/_=\-]"),
            "hex": flag(F.regexp_like(lower, F.lit("^[0-9a-f]+$"))),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
            "turns": _share(lower, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
            "covered": (F.length(v) - F.length(F.regexp_replace(lower, "|".join(longest), ""))) / F.length(v),
            "path_test": flag(F.regexp_like(path, F.lit("test|example|sample|fixture|mock|doc"))),
            "told": flag(F.regexp_like(before, F.lit(f"{TELLING}|{NAMES}"))),
            "assigned": flag(F.regexp_like(before, F.lit(r"[=:(]\W*$|://[^\s:/@]+:$"))),
            "other": flag(F.regexp_like(F.concat_ws(" ", before, after), F.lit(OTHER))),
            "stand_in": flag(F.regexp_like(F.concat_ws(" ", before, lower, after), F.lit(STAND_IN))),
        }
    )


def example_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """Labelled findings made by rule from hashes of their numbers: ``each`` of nine kinds of secrets and eleven of others, some of them in lookalike places."""
    h = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    part = lambda n, i=1: F.substring(h, i, n)
    name = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    verb = F.element_at(F.array(*map(F.lit, ["token =", "secret:", "api_key =", "password:", "auth_token =", "access key ="])), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int"))
    plain = F.element_at(F.array(*map(F.lit, ["the", "see", "of it", "in", "and then", "id"])), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int"))
    uuid = F.concat_ws("-", part(8), part(4, 9), part(4, 13), part(4, 17), part(12, 21))
    letters = lambda n, i=1: F.translate(part(n, i), "0123456789", "ghjkqrtvwx")
    syllables = F.array(*map(F.lit, "ba re ti no lu ment tion da ver so che lin por ste gra mi".split()))
    word = F.concat(*[F.element_at(syllables, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(16)) + 1).cast("int")) for k in (7, 8, 9, 10)])
    told = F.element_at(F.array(*map(F.lit, ["password:", "Passwort:", "secret =", "mot de passe :", "token:", "contraseña =", 'pwd = "', "passphrase:"])), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(8)) + 1).cast("int"))
    short = (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(8)) + 8).cast("int")
    kinds = [
        (F.substring(F.concat(name(1), part(8)), 1, 12), told, 1), (F.substring(letters(24), F.lit(1), short), told, 1), (F.substring(b64, F.lit(1), short), F.lit("postgres://admin:"), 1),
        (word, told, 0), (F.concat_ws("_", name(1), name(2)), told, 0), (F.element_at(F.array(*map(F.lit, ["changeme", "your_password", "<password>", "xxxxxxxxxx", "example123", "required", "optional"])), (F.pmod(F.xxhash64("id"), F.lit(7)) + 1).cast("int")), told, 0),
        (part(40), F.concat(verb, F.lit(' "')), 1), (part(32), verb, 1), (b64, verb, 1), (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), plain, 1),
        (F.concat(F.lit("AKIA"), F.upper(part(16))), verb, 1), (F.concat(F.lit("sk-live-"), F.substring(b64, 1, 24)), F.lit("Authorization: Bearer"), 1),
        (part(40), F.lit("commit"), 0), (h, F.lit("sha256 checksum:"), 0), (uuid, plain, 0), (part(32), F.lit("md5 digest ="), 0),
        (F.concat_ws("_", name(1), name(2), name(3), part(1)), plain, 0), (F.concat_ws("/", name(1), name(2), name(3), F.concat(name(4), F.lit("1"))), F.lit("path ="), 0),
        (F.concat(F.lit("your_"), name(1), F.lit("_token_here_123")), verb, 0), (F.concat(F.lit("example-key-"), F.lit("0000000000000000")), verb, 0),
    ]
    rows = None
    for k, (value, before, label) in enumerate(kinds):
        some = spark.range(k * each, (k + 1) * each).select(value.alias("value"), before.alias("before"), F.lit("").alias("after"), F.when(F.lit(label == 0) & (F.col("id") % 3 == 0), "docs/test/example").otherwise("src").alias("path"), F.lit(float(label)).alias("label"))
        rows = some if rows is None else rows.unionByName(some)
    return rows


def train(labelled: DataFrame, *, most_rows: int = 20_000, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel:
    """The forest, from at most ``most_rows`` labelled findings."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled.limit(most_rows)))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3, featureSubsetStrategy="onethird").fit(rows.select("features", "label"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, value, at, before, after): each candidate of (doc_id, path, text), its word's index and the words beside it."""
    has = [F.regexp_like("text", F.lit(p)) for p in (CANDIDATE, TOLD, IN_URL)]
    some = docs.filter(has[0] | has[1] | has[2]).select("doc_id", F.coalesce("path", F.lit("")).alias("path"), words(F.col("text")).alias("w"))
    near = lambda i, *ks: F.concat_ws(" ", *[F.get("w", i + k) for k in ks])
    run = F.regexp_like
    # Of a word: whether it has a run of 16, and what its own and the four words before it tell.
    told = lambda x, i: F.regexp_extract(F.concat_ws(" ", *[F.get("w", i - k) for k in (4, 3, 2, 1)], x), TOLD + r"[\"'`,;.)}\]]*$", 1)

    def hit(x: Column, i: Column) -> Column:
        long_, name, url = run(x, F.lit(CANDIDATE)), told(x, i), F.regexp_extract(x, IN_URL, 1)
        short = lambda v: F.when((v != "") & F.contains(x, v) & ~run(v, F.lit(CANDIDATE)), v)
        named = F.when(F.length(x) >= 8, short(name))
        return F.when(long_ | named.isNotNull() | (url != ""), F.struct(x.alias("x"), i.alias("i"), long_.alias("long"), F.array_distinct(F.array_compact(F.array(named, short(url)))).alias("short")))

    hits = F.filter(F.transform("w", hit), lambda s: s.isNotNull())
    rows = some.select("doc_id", "path", "w", F.explode(hits).alias("s"))
    rows = rows.select("doc_id", "path", F.col("s.i").cast("long").alias("at"), near(F.col("s.i"), -3, -2, -1).alias("b"), near(F.col("s.i"), 1, 2).alias("a"), "s.x", "s.long", "s.short")
    # What stands between the candidates of a word: the first has the words before it too, the last those after it.
    found = F.when(F.col("long"), F.regexp_extract_all("x", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.split("x", CANDIDATE, -1)
    last = F.size(found) - 1
    runs = F.transform(found, lambda v, k: F.struct(F.when(k == 0, F.concat_ws(" ", "b", F.get(gaps, k))).otherwise(F.get(gaps, k)).alias("before"), F.when(k == last, F.concat_ws(" ", F.get(gaps, k + 1), F.col("a"))).otherwise(F.get(gaps, k + 1)).alias("after"), v.alias("value")))
    others = F.transform("short", lambda v: F.struct(F.concat_ws(" ", "b", F.call_function("substring_index", F.col("x"), v, F.lit(1))).alias("before"), F.concat_ws(" ", F.call_function("substring_index", F.col("x"), v, F.lit(-1)), F.col("a")).alias("after"), v.alias("value")))
    return rows.select("doc_id", "path", "at", F.inline(F.concat(runs, others)))


def scanned(docs: DataFrame, model: RandomForestClassificationModel | None = None, *, least: float = 0.5) -> DataFrame:
    """Each candidate with the forest's ``score`` and ``is_secret``: whether that is at least ``least``."""
    model = model or train(example_findings(docs.sparkSession))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs)))
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= least).select("doc_id", "path", "at", "value", "before", "after", "score", "is_secret")
