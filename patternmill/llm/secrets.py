"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters with a digit or several changes of case, values assigned to names of secrets,
passwords in URLs and private keys in their blocks. The forest judges each by its length, its changes between kinds of
characters, how far words of a dictionary cover it, the path it stands in and the words next to it. The dictionary is
learned from the documents: all their words are counted. The forest is trained from labelled findings. All on the rows
is DataFrame functions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.llm.common import fenced, joinable, packed, place_bits, text_mark
from patternmill.session import forget, fresh_path, scratch, stored, written

NAMES = r"(?:password|passwd|passphrase|(?<![a-z])pass(?![a-z])|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
# A name of any length that holds such a word, and what assigns: = : == := => and the like, a colon with its value on the
# next line too. The sign is looked for first, as few words have one.
SIGN = r"\\?[\"']?\]?[ \t]*+[=:]"
NAME = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++{SIGN})(?=[A-Za-z0-9_-]*?{NAMES})[A-Za-z0-9_-]++"
NAMED = rf"(?i:{NAME}){SIGN}[=:]?+>?[ \t]*+(?:(?<=:)[ \t]*+\r?\n[ \t]*+)?"
# The password of a URL, up to the last @ before its path.
LOGIN = r"://[^\s/?#:@\"'<>]*+:"
PASSWORD = r"[^\s/?#\"'<>]+(?=@)"
URL = rf"(?<=[A-Za-z0-9+.-]){LOGIN}{PASSWORD}"
# A private key to its end; where that is missing, its lines.
OPEN, CLOSE = (rf"-----{side} [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----" for side in ("BEGIN", "END"))
BLOCK = rf"{OPEN}(?:(?:[^-]|-(?!----))*+{CLOSE}|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)++)"
# A value of any length: in quotes up to its own closing quote on the line, else up to a blank, quote or bracket or to
# the next assignment; possessive, so nothing is tried twice.
ELSEWHERE = rf"(?!-----BEGIN |[A-Za-z][A-Za-z0-9+.:-]*{LOGIN}{PASSWORD})"
QUOTED = "|".join(rf"{q}{ELSEWHERE}(?:[^{q}\\\r\n]|\\.){{4,}}+(?={q})" for q in "\"'") + rf"|\\\"{ELSEWHERE}[^\"\\\r\n]{{4,}}+(?=\\\")"
BARE = rf"\\?[\"']?{ELSEWHERE}(?:[^\s\"'<>&;,?]|[&;,?](?!{NAMED})){{4,}}+"
ASSIGNED = rf"{NAMED}(?:{QUOTED}|{BARE})"
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*+[0-9]|(?:[A-Za-z+/_-]*?[a-z][A-Z]){3})[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{BLOCK}|{URL}|{ASSIGNED}|{RUN}"
VALUE = rf"(?s)^(?:{NAMED}(?=.{{4}})(?:\\?[\"'](?=.{{4}})|\\(?=.{{4}}))?|{LOGIN})?(.*)$"

# Words of placeholders and names, which count as words whether the documents have them or not.
PLACEHOLDERS = (
    "example", "sample", "dummy", "test", "your", "here", "change", "placeholder", "default", "value", "name", "string", "null", "none", "true", "false", "user", "admin", "server", "client", "config",
    "local", "library", "package", "python", "java", "script", "module", "version", "release", "build", "file", "path", "home", "index", "page", "image", "static", "content", "article", "category",
    "product", "search", "request", "response", "handler", "manager", "service", "factory", "controller", "function", "class", "object", "array", "list", "from", "with", "this", "that", "have", "the",
    "and", "get", "set", "chapter", "section", "figure", "table", "report", "update", "news", "blog", "post", "date", "time",
)
#: Words of the dictionary: those in the most documents, but in LEAST_DOCS at least; their lengths.
DICTIONARY_WORDS, LEAST_DOCS, LEAST_WORD, MOST_WORD = 20_000, 5, 4, 16
#: Labelled findings that are used for training at most; Spark samples no further rows.
TRAINING_ROWS = 8_000
TREES, DEPTH, SEED = 20, 8, 7
BEFORE, AFTER = 48, 24
#: Letters of a piece in which words are looked up, and candidates of a block over which lengths are added up.
PIECE, BLOCKED = 256, 256
#: What may stand between the values of a list, and how many values of it are looked back over.
BETWEEN, BACK = r"^[\s\"',;|\[\]\\]*$", 4

#: Words of what is said about a secret, rather than of one.
SPOKEN = "password|token|key|secret|credentials?|your|please|enter|invalid|must|should|the|is|are|was|not|wrong|incorrect|missing|required|expired|forgot|reset|change|sign|log|for|of|to|a|an|and|or|with|from|new|old|least|characters?"

FEATURES = ["f_length", "f_changes", "f_digits", "f_upper", "f_other", "f_distinct", "f_hex", "f_vowels", "f_words", "f_test_path", "f_code_path", "f_named", "f_assigned", "f_hash_near", "f_fake_near", "f_url_near", "f_after_word", "f_login", "f_block", "f_blanks", "f_spoken"]


def candidates(docs: DataFrame, path: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, mark, finding_no, start, length, value, before, after, path), one per candidate; start counts characters from 0.

    mark is the text_mark of the row; before and after are the characters next to the candidate, not cut at other
    candidates of a list: there what stands before the list, and the name of its first value, count for all.
    Null and empty texts have no candidates. Long texts are scanned whole. Repeated rows repeat their findings. No shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), t.alias("__t")).withColumn("__m", F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0)))
    some = fenced(found, "__m").where(F.size("__m") > 0).withColumn("__s", F.split("__t", CANDIDATE, -1))
    added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    ends = F.transform(F.col("__m"), lambda m, i: (F.length(m) + F.length(F.get("__s", i))).cast("long"))
    some = fenced(some.withColumn("__lens", ends).withColumn("mark", text_mark("__t", "path")).drop("__t"), "__lens")
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("__lens") - 1) / BLOCKED).cast("int")), lambda b: added(F.slice("__lens", b * BLOCKED + 1, F.lit(BLOCKED))))
    rows = fenced(some.withColumn("__sums", sums), "__sums").select("doc_id", "mark", "path", "__s", "__m", "__lens", "__sums", F.posexplode("__m").alias("finding_no", "__match"))
    value = F.regexp_extract("__match", VALUE, 1)
    block = F.floor(F.col("finding_no") / BLOCKED).cast("int")
    end = added(F.slice("__sums", F.lit(1), block)) + added(F.slice("__lens", block * BLOCKED + 1, F.col("finding_no") % BLOCKED + 1))
    gap = lambda k: F.coalesce(F.get("__s", F.col("finding_no") + k), F.lit(""))
    left = F.lit("")
    for k in range(-BACK, 1):
        earlier = F.regexp_extract(F.coalesce(F.get("__m", F.col("finding_no") + k - 1), F.lit("")), f"^(?:{NAMED})?", 0)
        left = F.right(F.when(gap(k).rlike(BETWEEN), F.concat(left, earlier, gap(k))).otherwise(F.right(gap(k), F.lit(BEFORE))), F.lit(BEFORE))
    cut = rows.select("doc_id", "mark", "finding_no", end.alias("__end"), value.alias("value"), "path", F.col("__match"), left.alias("__left"), F.left(gap(1), F.lit(AFTER)).alias("after"))
    name = F.left("__match", F.length("__match") - F.length("value"))
    return cut.select(
        "doc_id", "mark", "finding_no", (F.col("__end") - F.length("value")).cast("long").alias("start"), F.length("value").cast("long").alias("length"), "value", F.concat("__left", name).alias("before"), "after", "path"
    )


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS, least: int = LEAST_DOCS) -> DataFrame:
    """Stored rows (word): PLACEHOLDERS, and of the lower-case or capitalised words of all documents those in the most.

    Words are counted once a document, over all documents; no words or documents give the placeholders alone. The
    table has `words` rows and the placeholders at most.
    """
    told = F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+", -1)
    own = F.filter(F.array_distinct(told), lambda w: w.rlike(rf"^(?=.{{{LEAST_WORD},{MOST_WORD}}}$)\p{{Lu}}?\p{{Ll}}+$"))
    counted = docs.select(F.explode(own).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in PLACEHOLDERS])).alias("word"))
    return stored(counted.orderBy(F.desc("n"), "word").limit(words).select("word").unionByName(fixed).distinct(), "dictionary")


def word_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(__id, covered): how many characters of the value of each row (__id, value) lie in words of the dictionary; rows without any are left out.

    Each stretch of letters is looked up at every place where a word may begin and at each of its lengths, so words that
    are run together count too. Stretches are cut into pieces of PIECE letters, and as many more as a word may reach
    over, so the work grows with the length of a value; what is covered is kept as bits, which are joined before they
    are shuffled.
    """
    runs = found.select("__id", F.posexplode(F.regexp_extract_all(F.lower("value"), F.lit(rf"\p{{L}}{{{LEAST_WORD},}}"), F.lit(0))).alias("run", "letters"))
    cut = fenced(runs.select("__id", "run", F.regexp_extract_all("letters", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("cut")), "cut")
    wide = F.transform("cut", lambda c, i: F.concat(c, F.left(F.coalesce(F.get("cut", i + 1), F.lit("")), F.lit(MOST_WORD - 1))))
    pieces = cut.select("__id", "run", F.posexplode(wide).alias("piece", "part")).where(F.length("part") >= LEAST_WORD)
    places = pieces.select("__id", "run", "piece", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("part") - LEAST_WORD + 1))).alias("low"))
    heads = words.select(F.left("word", F.lit(LEAST_WORD)).alias("head")).distinct()
    begun = places.withColumn("head", F.substring("part", F.col("low"), F.lit(LEAST_WORD))).join(F.broadcast(heads), "head")
    long = begun.withColumn("n", F.explode(F.sequence(F.lit(LEAST_WORD), F.least(F.lit(MOST_WORD), F.length("part") - F.col("low") + 1))))
    hits = long.select("__id", "run", (F.col("piece") * PIECE + F.col("low") - 1).alias("start"), "n", F.substring("part", F.col("low"), F.col("n")).alias("word")).join(F.broadcast(words), "word")
    bits = hits.select("__id", "run", F.explode(place_bits(F.col("start"), F.col("n"))).alias("c")).groupBy("__id", "run", "c.at").agg(F.bit_or("c.bits").alias("bits"))
    return bits.groupBy("__id").agg(F.sum(F.bit_count("bits")).alias("covered"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add FEATURES (doubles) to rows with value, before, after, path and a number of their own, __id, from a written table; nulls count as empty."""
    found = found.join(word_coverage(found, words), "__id", "left")
    v, n = F.coalesce("value", F.lit("")), F.greatest(F.length("value"), F.lit(1))
    before, after, path = (F.coalesce(c, F.lit("")) for c in ("before", "after", "path"))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c, pattern: c.rlike(pattern).cast("double")
    made: dict[str, Column] = {
        "f_length": F.least(F.length(v), F.lit(512)),
        "f_changes": (F.regexp_count(v, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) - 1) / n,
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_other": share("[^A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))),
        "f_hex": flag(v, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "f_vowels": share("[aeiouAEIOU]"),
        "f_words": F.coalesce("covered", F.lit(0)) / n,
        "f_test_path": flag(path, r"(?i)test|example|sample|mock|fixture|docs?/"),
        "f_code_path": flag(path, r"(?i)\.(?:py|js|ts|java|go|env|ya?ml|json|cfg|ini|properties|sh)$"),
        "f_named": flag(before, rf"(?i){NAMES}|bearer|aws"),
        "f_assigned": flag(before, r"[=:]>?\s*\\?[\"']?$"),
        "f_hash_near": flag(F.concat(before, F.left(v, F.lit(8))), r"(?i)commit|sha-?\d*|md5|checksum|digest|etag|uuid|revision|integrity"),
        "f_fake_near": flag(F.concat(before, v, after), r"(?i)example|sample|dummy|placeholder|your[_-]|changeme|xxxx|<[a-z_ -]+>|\$\{"),
        "f_url_near": flag(before, r"(?:://|www\.|/)[^\s\"']*$"),
        "f_after_word": flag(after, r"^[\"']?[\s,.;)]|^$"),
        "f_login": flag(before, LOGIN + "$"),
        "f_block": flag(v, f"^{OPEN}"),
        "f_blanks": share(r"[ \t]"),
        "f_spoken": F.regexp_count(v, F.lit(rf"(?i)\b(?:{SPOKEN})\b")),
    }
    return found.withColumns({k: c.cast("double") for k, c in made.items()}).drop("covered")


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings of known make, for training where none are at hand: (value, before, after, path, label).

    Secrets are hex, base64 and prefixed keys and short passwords next to names of secrets, passwords in URLs and
    private keys; the false ones are hashes of commits and files, identifiers, numbers, paths of URLs, names, constants,
    placeholders (in URLs and blocks too) and long words.
    """
    r = lambda k: f"pmod(xxhash64(id, {k}), 1000)"
    hex40, hex32, hex64 = "sha1(concat('a', id))", "md5(concat('b', id))", "sha2(concat('c', id), 256)"
    b64 = "regexp_replace(base64(unhex(sha2(concat('d', id), 256))), '[^A-Za-z0-9]', 'x')"
    digits = "translate(sha1(concat('e', id)), 'abcdef', '123456')"
    pick = lambda k, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast({r(k)} % {len(xs)} + 1 as int))"
    word = pick(20, "the", "und", "le", "value", "of", "config", "est", "note", "see", "la", "de", "")
    name = pick(21, "token", "secret", "api_key", "password", "access_key", "auth_token", "TOKEN", "API_KEY", "client_secret", "Password", "private_key")
    join = pick(22, ' = "', ' = ', ": ", '="', "=", ': "', " = '")
    login = f"concat({pick(25, 'postgres', 'https', 'redis', 'mongodb+srv', 'amqp', 'ftp')}, '://', {pick(26, 'user', 'admin', 'app', '', 'root')}, ':')"
    host = f"concat('@', {pick(27, 'localhost', 'db.internal', 'host', '10.0.0.5')}, {pick(28, ':5432/app', '/', '', ':6379')})"
    block = lambda body: f"concat('-----BEGIN ', kind, 'PRIVATE KEY-----', chr(10), {body}, chr(10), '-----END ', kind, 'PRIVATE KEY-----')".replace("kind", pick(29, "RSA ", "EC ", "", "OPENSSH "))
    passphrase = f"concat({pick(33, 'violet', 'Marble', 'thunder', 'quiet')}, {pick(34, 'harbor', 'Pickle', 'lantern', 'otter')}, {pick(35, 'Sunday', 'basket', 'gravel', 'piano')}, {pick(36, '', 'zebra', 'Copper', 'window')})"
    spoken = "regexp_replace(regexp_replace(regexp_replace(translate(left(sha1(concat('f', id)), cast(8 + id % 9 as int)), '0123456789abcdef', 'lrnstkdmbgpvfhzw'), '([lrnst])', '$1e'), '([kdmbg])', '$1a'), '([pvfhzw])', '$1oi')"
    prefix = pick(38, "sk_live_", "sk_test_", "xoxb-", "glpat-", "pk_live_", "SG.", "npm_", "rk_")
    some = lambda k: pick(k, "violet", "harbor", "pickle", "lantern", "otter", "gravel", "piano", "zebra", "copper", "window", "marble", "thunder", "basket", "river", "stone", "candle")
    phrase = f"concat_ws(' ', {some(40)}, {some(41)}, {some(42)}, CASE WHEN {r(43)} % 3 > 0 THEN {some(44)} END, CASE WHEN {r(45)} % 4 = 0 THEN cast(id % 90 as string) END)"
    odd = f"concat(left({b64}, cast({r(46)} % 6 + 3 as int)), {pick(47, '<', '>', '&', ';', ',', ' ', '?', '$')}, left({hex32}, cast({r(48)} % 6 + 4 as int)))"
    quoted = pick(49, ' = "', ': "', ' => "', ' := "', '="', '=> "')
    said = f"concat({pick(50, 'Enter your', 'Please enter the', 'Invalid', 'The', 'Forgot your', 'Reset the', 'your new', 'Wrong')}, ' ', {pick(51, 'password', 'token', 'secret', 'API key', 'user name', 'passphrase')}, {pick(52, '', ' here', ' is missing', ' must not be empty', '?', ' for this account', ' to go on', '.')})"
    bare = pick(39, '("', "(", "['", "= ", "key ", ", ", ": '")
    letters = "translate(left(" + b64 + ", 24), '0123456789', 'QwZrTkVbNp')"
    good = [
        (f"concat({prefix}, left({b64}, cast({r(31)} % 16 + 20 as int)))", f"concat({word}, {bare})"), (passphrase, f"concat({pick(37, 'password', 'passwd', 'db_password', 'PASSWORD', 'user_pwd')}, {join})"), (letters, f"concat({word}, ' ', {name}, {join})"),
        (hex40, f"concat({word}, ' ', {name}, {join})"), (f"upper({hex40})", f"concat({word}, ' ', upper({name}), {join})"), (hex32, f"concat({word}, ' ', {name}, {join})"), (f"left({b64}, 40)", f"concat('aws_', {name}, {join})"),
        (f"concat('AKIA', upper(left({b64}, 16)))", f"concat({word}, ' ')"), (f"concat('ghp_', left({b64}, 36))", f"concat({word}, ' ')"), (f"concat('sk-', left({b64}, 40))", f"concat({name}, {join})"),
        (f"left({b64}, 43)", "'Authorization: Bearer '"), (f"concat(left({b64}, 6), '!', left({hex32}, 6))", f"concat({name}, {join})"), (hex64, f"concat({word}, ' ', {name}, {join})"),
        (f"concat({pick(30, 'hunter', 'Pw!', 's3cr', 'x', 'Tr0ub')}, left({hex32}, cast({r(31)} % 4 + 2 as int)))", f"concat({word}, ' ', {name}, {join})"), (f"concat({pick(30, 'hunter', 'Pw!', 's3cr', 'x', 'Tr0ub')}, left({hex32}, cast({r(31)} % 12 + 1 as int)))", f"concat({word}, ' ', {login})", host),
        (phrase, f"concat({name}, {quoted})"), (odd, f"concat({word}, ' ', {name}, {quoted})"),
        (f"left({b64}, cast({r(31)} % 30 + 10 as int))", f"concat({word}, ' ', {login})", host), (block(f"repeat(concat({b64}, chr(10)), cast({r(31)} % 20 + 3 as int))"), f"concat({word}, ' ')"),
    ]
    bad = [
        (pick(32, "Bearer", "Basic", "Token", "Digest", "Negotiate"), "'Authorization: '"), (f"concat({pick(32, 'sha512-', 'sha384-', 'sha256-')}, {b64}, '=')", f"concat({word}, {pick(39, ' integrity: ', ' ', '=')}, chr(34))"),
        (f"concat({spoken}, {pick(32, '', '-')}, id % 1000)", f"concat({word}, ' ')"), (f"concat({spoken}, '-', {spoken}, '-', id % 100)", f"concat({word}, {pick(39, '/', ' ', chr(34))})"),
        (hex40, f"concat({word}, ' commit ')"), (hex64, f"concat({word}, ' sha256: ')"), (hex32, "'md5sum '"), (f"concat(left({hex32}, 8), '-', substring({hex32}, 9, 4), '-4', substring({hex32}, 14, 3), '-a', substring({hex32}, 18, 3), '-', right({hex32}, 12))", f"concat({word}, ' uuid=')"),
        (f"left({digits}, 16)", f"concat({word}, ' ')"), (f"left({digits}, 18)", f"concat({word}, ': ')"), ("concat('news/2024/article-', id, '-update-report')", "'https://site.example.com/'"), ("concat('usr/local/lib/python3/package', id)", "'/'"),
        ("concat('your_token_here_', id % 100)", f"concat({name}, {join})"), ("concat('example-value-', id % 1000)", f"concat({name}, {join})"), ("concat('xxxxxxxxxxxxxxxx', id % 1000)", f"concat({name}, {join})"), ("concat('getUserById', id % 10, 'FromServiceFactory')", f"concat({word}, ' ')"),
        ("concat('donaudampfschiff', translate(cast(id % 977 as string), '0123456789', 'aeioulmnrt'), 'gesellschaft', id % 10)", f"concat({word}, ' ')"), ("concat('2024-01-02T03-04-', id % 60, '-report')", f"concat({word}, ' ')"), ("concat('os.environ[', id % 10, ']')", f"concat({name}, {join})"),
        ("concat('changeme', id % 1000)", f"concat({name}, {join})"), (f"left({digits}, 20)", f"concat({word}, ' id ')"), ("concat(repeat('th', cast(id % 9 + 8 as int)), id % 10)", f"concat({word}, ' ')"),
        (pick(32, "None", "true", "false", "null", "self", "required", "string", "get()", "user"), f"concat({word}, ' ', {name}, {join})"), (pick(32, "changeme", "your-password", "example", "xxxxxxxx", "placeholder"), f"concat({word}, ' ', {login})", host),
        (block("'your-private-key-goes-here'"), f"concat({word}, ' ')"), (said, f"concat({name}, {quoted})"),
    ]
    case = lambda rows, at: "CASE " + " ".join(f"WHEN {r(1)} % {len(rows)} = {k} THEN {x[at]}" for k, x in enumerate(rows) if len(x) > at) + " END"
    after = f"concat({pick(23, chr(34), '', chr(34) + '}', chr(34) + '|', chr(34) + ',', '.', chr(34) + ')', ';', chr(34) + '#', chr(34) + '<br>', chr(34) + '&', chr(34))}, ' ', {word})"
    path = pick(24, "src/main.py", "config/app.yml", "docs/readme.md", "tests/test_a.py", "example.org", "crawl-7", "deploy/.env", "web/index.js", "", "notes.txt")
    made = spark.range(0, rows, 1, 1).selectExpr("id", f"id % 2 AS label", f"CASE WHEN id % 2 = 1 THEN {case(good, 0)} ELSE {case(bad, 0)} END AS value", f"CASE WHEN id % 2 = 1 THEN {case(good, 1)} ELSE {case(bad, 1)} END AS before", f"coalesce(CASE WHEN id % 2 = 1 THEN {case(good, 2)} ELSE {case(bad, 2)} END, {after}) AS after", f"{path} AS path")
    return made.select("id", "value", "before", "after", "path", F.col("label").cast("double").alias("label"))


def train(labelled: DataFrame, words: DataFrame, rows: int = TRAINING_ROWS) -> PipelineModel:
    """Fit the forest to at most `rows` labelled findings (value, before, after, path, label 0 or 1)."""
    bounded = stored(labelled.select("value", "before", "after", "path", "label").limit(rows).coalesce(1).withColumn("__id", F.monotonically_increasing_id()), "labelled")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = PipelineModel([assembler, forest.fit(assembler.transform(with_features(bounded, words).coalesce(1).sortWithinPartitions("__id")))])
    forget(bounded)
    return model


def judge(found: DataFrame, model: PipelineModel, words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add score (the forest's probability that it is a secret) and confirmed to the rows that with_features takes."""
    scored = model.transform(with_features(found, words))
    drop = [c for c in (*FEATURES, "features", "rawPrediction", "probability", "prediction") if c in scored.columns]
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.withColumn("score", score).withColumn("confirmed", F.col("score") >= threshold).drop(*drop)


def judged(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of all documents with score and confirmed. They are written to the shared folder in between, values included."""
    words = dictionary(docs)
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), words)
    found = stored(candidates(docs).withColumn("__id", F.monotonically_increasing_id()), "candidates")
    return judge(found, model, words).drop("__id")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of all documents with their verdicts: doc_id, finding_no, start, length, value, path, score, confirmed."""
    return judged(docs, labelled).select("doc_id", "finding_no", "start", "length", "value", "path", "score", "confirmed")


def report(docs: DataFrame) -> DataFrame:
    """The findings without the secrets themselves, as a stored table; the candidates that were written on the way are deleted."""
    spark = docs.sparkSession
    with scratch(spark):
        told = scan(docs).select("doc_id", "finding_no", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "confirmed")
        return written(told, fresh_path(spark, "findings", kept=True))


def redacted(docs: DataFrame, mask: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """All rows of docs, with each confirmed secret in the text replaced by the mask; n_chars, if there, set anew.

    Findings go to the rows with their doc_id, text and source, so rows without a doc_id or with the same one keep their own.
    A text with confirmed findings is cut at its candidates once more and put together again, in time that grows with its length.
    """
    with scratch(docs.sparkSession):
        found = written(judged(docs, labelled).select("doc_id", "mark", "finding_no", F.when(F.col("confirmed"), F.col("length")).alias("length")).distinct(), fresh_path(docs.sparkSession, "verdicts", kept=True))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("finding_no", "length"))), lambda x: x["length"])
    told = found.groupBy(F.col("doc_id").alias("__doc"), F.col("mark").alias("__of")).agg(lengths.alias("__lengths"), F.count("length").alias("__n")).where("__n > 0").drop("__n")
    joined = packed(docs, "doc_id", "text", text_mark().alias("__mark")).join(joinable(told), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__of")), "left")
    held = F.col("__lengths").isNotNull()
    cut = fenced(joined.withColumn("__m", F.when(held, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))).withColumn("__s", F.when(held, F.split("text", CANDIDATE, -1))), "__m", "__s")

    def after(i: Column) -> Column:
        match, length = F.get("__m", i), F.get("__lengths", i)
        return F.when(length.isNull(), F.coalesce(match, F.lit(""))).otherwise(F.concat(F.left(match, (F.length(match) - length).cast("int")), F.lit(mask)))

    masked = F.array_join(F.transform("__s", lambda piece, i: F.concat(piece, after(i))), "")
    made = fenced(cut.withColumn("__masked", masked), "__masked")
    row = F.col("__row").withField("text", F.col("__masked"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("__masked").cast(docs.schema["n_chars"].dataType))
    return made.select(F.when(held, row).otherwise(F.col("__row")).alias("__row")).select("__row.*")
