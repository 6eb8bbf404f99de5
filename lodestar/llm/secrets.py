"""Secret scans with a random forest that removes false positives. DataFrame and JVM ML functions only.

Candidates are runs of key-like characters in the whole text (dots inside them count, as in signed tokens), shorter runs of any
characters right after a keyword such as `password =`, passwords in connection strings and on command lines, and bodies of
private keys. Each gets features: length, character transitions, digits, marks, coverage by a dictionary, path characters
around it, neighbouring words that speak for or against a secret, a known prefix. A random forest trained on labelled findings
votes; its trees are turned into one SQL expression, so that a text is scanned, scored and redacted within its own row,
without a shuffle.

The labelled findings are LABELLED rows (a bound, and a parameter) made by rule from md5 digests: keys, passwords and tokens in
the forms that leak, and what looks like them - commit ids, UUIDs, long words, identifiers, paths, numbers, placeholders.

Defined cases: a null or empty text has no findings and stays as it is; long texts are scanned whole; a candidate is a
maximal run, so findings never overlap; repeated rows get equal results; an empty table gives an empty result. Added columns
replace input columns of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

#: Words that name a secret before it.
KEYWORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|account[_ -]?key|signing[_ -]?key|encryption[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer|credentials?)"
_RUN = r"[A-Za-z0-9_\-+/]"
CANDIDATE = "|".join([
    # the body of a private key
    r"(?<=-----)(?<=-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----)[A-Za-z0-9+/=\s]{16,}",
    # after a keyword: characters of any kind, fewer of them
    r"(?<=[:=][\x22\x27 ]{0,2})(?<=(?i:" + KEYWORD + r")[A-Za-z0-9_]{0,8}[\x22\x27]? ?[:=][\x22\x27 ]{0,2})[^\s\x22\x27<>;,`(){}]{8,}",
    # in a connection string, on a command line
    r"(?<=:)(?<=://[\w.-]{1,40}:)[^\s/@]{6,}(?=@)",
    r"(?<= -p)(?<=(?i:mysql|mysqldump|mysqladmin)[ \w.-]{0,40} -p)[^\s\x22\x27]{6,}",
    r"(?=(?:" + _RUN + r"|\.(?=" + _RUN + r")){16})" + _RUN + r"++(?:\." + _RUN + r"++)*+={0,2}",
])
CONTEXT = 48  # code points before a candidate that are looked at
LABELLED = 4000
TREES, DEPTH, SEED = 15, 6, 11
THRESHOLD = 0.5
REDACTED = "[SECRET]"
BLOCK = 64  # candidates whose lengths are summed at a time

#: Common words and word parts of four languages and of code, longest first where one begins another.
DICTIONARY = (
    "about|access|account|active|after|aktion|also|amiento|android|another|application|array|assets|attribute|auch|author|avant|avec|backend|base|because|been|before|build|button|cache|change|check|class|client|color|"
    "column|comment|common|component|config|connection|consider|content|context|control|corpus|country|create|current|customer|data|database|date|default|delete|descriptor|desde|developer|different|dis|document|double|eine|"
    "element|ement|encode|entre|environment|error|event|example|factory|field|file|filter|first|format|framework|from|function|general|generat|group|handler|have|header|heit|html|http|icht|image|import|index|infor|"
    "instance|inter|isation|ization|java|keit|language|latest|length|letter|library|list|local|machine|main|manager|mation|matic|mente|message|method|microservice|model|module|name|nation|nicht|node|number|object|operat|"
    "option|order|organis|other|output|page|parameter|para|parse|path|people|pour|present|process|product|project|proto|public|python|query|record|register|release|request|resource|response|result|return|river|sample|schema|"
    "schaft|search|select|serial|server|service|session|setting|should|sich|size|source|sson|start|state|static|stream|string|structure|style|switch|system|table|target|template|test|text|their|there|thing|think|this|"
    "through|time|tion|title|toggle|track|train|transform|type|under|update|upload|user|util|value|variable|version|view|walker|water|website|which|widget|window|with|word|world|would|write|"
    "able|ance|ando|ation|der|die|een|ein|eit|ent|ers|est|ier|ing|ion|ique|ity|les|lich|lly|ness|oder|ous|que|sch|sta|str|the|und|ung|ver|and|com|for|get|set|not|der|con|pro|pre|www|er|re|on|in|an|en|le|de|is|al|ou|st|ha|nd"
)
FOR = r"(?i)(" + KEYWORD[3:-1] + r"|[_-]key)[a-z0-9_]{0,8}[\x22\x27]?\s*(?:=>|:|=|\s)+\s*(bearer\s+|basic\s+)?[\x22\x27]?$|://[\w.-]{1,40}:$|mysql\w*[ \w.-]* -p$|PRIVATE KEY-----\s*$"
AGAINST = r"(?i)(commit|sha-?1?|sha256|md5|hash|checksum|digest|uuid|guid|revision|etag|id|image|version|integrity|fingerprint|build|blob|tree|parent)[\x22\x27]?\s*(:|=|\s)+\s*[\x22\x27]?$"
PREFIX = r"^(AKIA[A-Z0-9]{16}$|ASIA[A-Z0-9]{16}$|gh[pousr]_|github_pat_|xox[abpr]-|sk_live_|rk_live_|sk-|AIza|glpat-|eyJ|npm_|SG\.|hf_|dop_v1_|ya29\.|pypi-)"
PLACEHOLDER = r"(?i)(example|changeme|change_me|placeholder|your[_-]|xxxx|dummy|sample|0000000|123456789|\*\*\*\*|\$\{|%\(|todo|redacted|getenv|environ)"

FEATURES = ("size", "transitions", "digits", "coverage", "path", "for", "against", "prefix", "placeholder", "uuid", "marks", "cases")


def features(c: str, before: str, after: str) -> str:
    """SQL of array<double>, FEATURES of a candidate c between the texts before and after."""
    classes = f"translate({c}, '{''.join(map(chr, [*range(97, 123)]))}{''.join(map(chr, [*range(65, 91)]))}0123456789', '{'a' * 26}{'A' * 26}{'0' * 10}')"
    n = f"greatest(length({c}), 1)"
    flag = lambda x: f"double({x})"
    return (
        f"array(double(length({c})),"
        f" regexp_count({classes}, '(?<=a)(?=[A0])|(?<=A)(?=[a0])|(?<=0)(?=[aA])') / {n},"
        f" (length({c}) - length(regexp_replace({c}, '[0-9]', ''))) / {n},"
        f" (length({c}) - length(regexp_replace(lower({c}), '{DICTIONARY}', ''))) / {n},"
        f" double(regexp_count({c}, '/|__') + int({before} rlike '[./~][A-Za-z0-9_-]*$') + int({after} rlike '^[./][A-Za-z0-9]')),"
        f" {flag(f'{before} rlike {_sql(FOR)}')}, {flag(f'{before} rlike {_sql(AGAINST)}')}, {flag(f'{c} rlike {_sql(PREFIX)}')}, {flag(f'{c} rlike {_sql(PLACEHOLDER)}')},"
        f" {flag(f'{c} rlike {_sql(UUID)}')},"
        f" (length({c}) - length(regexp_replace({c}, '[^A-Za-z0-9_/.=+-]', ''))) / {n},"
        f" double(int({c} rlike '[a-z]') + int({c} rlike '[A-Z]') + int({c} rlike '[0-9]')))"
    )


UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """c, before, after, label: made by rule, the same on every run."""
    d = F.md5(F.concat(F.lit("secret|"), F.col("id").cast("string")))
    e = F.md5(F.concat(F.lit("more|"), F.col("id").cast("string")))
    de = F.concat(d, e)
    upper = F.upper(F.translate(de, "01", "qz"))
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(de, F.reverse(de)))), r"[=\s]", "")
    mixed = F.regexp_replace(base64, r"[+/]", "x")
    words = F.translate(F.substring(de, 1, 6), "0123456789abcdef", "etaoinshrdlucmfw")
    seed = F.col("id") / 40
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.col("id"), F.lit(len(options))), F.lit(len(options))) + 1).cast("int"))
    said = pick("password=", 'token = "', "api_key: ", "secret=", "Authorization: Bearer ", "access_key = ", "passwd: ", "auth_token=", "DB_PASSWORD: ", "client_secret = '", 'secretKey": "', "export API_KEY=", "aws_secret_access_key = ", "_authToken=", "pwd = ")
    about = pick("commit ", "sha256: ", "md5=", "digest: ", "revision ", "uuid: ", "hash = ", "image: ", "checksum: ", "integrity=", "build ", "etag: ", "git_commit_id = ", "parent ")
    plain = pick("of the ", "and ", "see ", "die ", "que la ", "", "with. ", "in\n", ", ", "(", "for (", "les ", "= ", '"')
    after = pick(" ", "\n", '"', "'", ";", " and ", ", ", "")
    name = pick("getConfigValueOrDefault", "nationalisation_and_interest", "internationalization", "thetionandingerent", "StringIndexTestModule", "einverstaendniserklaerung", "withoutthenationingers", "considerationesdelente", "application-user-settings", "com.example.service.UserHandler", "lesorganisationsinternationales", "self.assertEqualResponse")
    word = pick("river", "orange", "walker", "summer", "dragon", "winter", "monkey", "cloud")
    marks = pick("!", "@", "#", "$", "!!", "?", "%", "#1")
    human = F.concat(F.initcap(word), F.substring(F.regexp_replace(d, "[a-f]", ""), 1, 4), marks)
    cases = [  # candidate, before, label
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, 1),
        (F.substring(d, 1, 18), said, 1),
        (F.substring(de, 1, 40), said, 1),
        (F.substring(de, 1, 64), said, 1),
        (F.concat(pick("ghp_", "gho_", "npm_", "hf_", "glpat-", "sk_live_", "xoxb-"), F.substring(mixed, 1, 36)), plain, 1),
        (F.substring(mixed, 1, 32), said, 1),
        (F.substring(mixed, 1, 24), said, 1),
        (F.substring(base64, 1, 40), said, 1),
        (F.concat(F.substring(base64, 1, 43), F.lit("=")), said, 1),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 17), F.lit(".eyJ"), F.substring(mixed, 20, 30), F.lit("."), F.substring(base64, 3, 43)), F.when(seed % 2 < 1, said).otherwise(plain), 1),
        (F.concat(F.lit("SG."), F.substring(mixed, 1, 22), F.lit("."), F.substring(mixed, 5, 43)), plain, 1),
        (human, said, 1),
        (F.concat(F.substring(mixed, 1, 5), marks, F.substring(mixed, 9, 5)), said, 1),
        (F.substring(mixed, 1, 12), said, 1),
        (F.substring(mixed, 1, 12), F.concat(pick("postgres", "mysql", "mongodb", "redis", "amqp"), F.lit("://"), word, F.lit(":")), 1),
        (human, F.concat(pick("https", "postgresql", "mongodb+srv"), F.lit("://admin:")), 1),
        (human, pick("mysql -u root -p", "mysqldump --host db -p", "mysql -h localhost -p"), 1),
        (F.concat(F.lit("\n"), base64, F.lit("\n"), F.reverse(base64), F.lit("\n")), pick("-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"), 1),
        (F.substring(mixed, 1, 30), F.concat(word, pick("_key = ", "_secret: ", "-token=", "_password = '")), 1),
        (F.substring(upper, 1, 28), said, 1),
        (F.substring(de, 1, 40), about, 0),
        (d, about, 0),
        (F.substring(de, 1, 40), plain, 0),
        (F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12)), F.when(seed % 2 < 1, about).otherwise(plain), 0),
        (F.concat(name, words), plain, 0),
        (F.concat(words, F.lit("tionanderthe"), words), plain, 0),
        (F.concat(F.lit("src/main/java/"), words, F.lit("/"), name), plain, 0),
        (F.concat(word, F.lit("/"), words, F.lit("/"), name, F.lit(".html")), F.concat(plain, F.lit("https://www.example.com/")), 0),
        (F.translate(F.substring(de, 1, 16), "abcdef", "123456"), plain, 0),
        (F.concat(F.lit("example-"), F.substring(d, 1, 12)), said, 0),
        (F.concat(F.lit("your_api_key_here_"), words), said, 0),
        (F.concat(F.lit("${"), F.upper(word), F.lit("_PASSWORD")), said, 0),
        (F.concat(name, F.substring(d, 1, 4)), F.concat(plain, F.lit("https://www.example.com/")), 0),
        (pick("required", "undefined", "optional", "forgotten", "incorrect", "nullable", "settings.password", "os.environ.get", "user.password", "config.secret_value", "validated"), said, 0),
        (F.concat(word, F.lit("-"), words, F.lit("-module"), F.lit("/"), name), plain, 0),
        (F.concat_ws(".", word, words, F.lit("service"), name), plain, 0),
        (F.concat(F.lit("sha512-"), F.substring(base64, 1, 60), F.lit("==")), about, 0),
        (F.concat(name, F.lit("_"), words, F.lit("_v2")), said, 0),
        (F.concat(F.lit("2024-01-01T00-"), F.translate(F.substring(d, 1, 8), "abcdef", "012345")), plain, 0),
        (F.concat_ws("_", words, word, F.lit("table"), F.reverse(words)), plain, 0),
    ]
    cases = [(c, b, after, label) for c, b, label in cases]
    column = lambda k: F.element_at(F.array(*[F.lit(c[k]) if isinstance(c[k], int) else c[k] for c in cases]), (F.col("id") % len(cases) + 1).cast("int"))
    return spark.range(0, rows, 1, 1).select(column(0).alias("c"), column(1).alias("before"), column(2).alias("after"), column(3).cast("double").alias("label"))


def forest_sql(debug: str, trees: int, x: str) -> str:
    """A random forest's description as SQL: the share of trees that vote for a secret."""
    lines = [line.strip() for line in debug.splitlines() if re.match(r"\s*(Tree|If|Else|Predict)", line)]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: ([\d.Ee+-]+)", line):
            return f"{float(m[1])}D"
        feature, _, limit = re.match(r"If \(feature (\d+) (<=|in) ([-\d.Ee+]+)\)", line).groups()
        then = node()
        at += 1  # its Else
        return f"IF({x}[{feature}] <= {float(limit)!r}D, {then}, {node()})"

    votes = []
    while at < len(lines):
        at += 1  # Tree n
        votes.append(node())
    assert len(votes) == trees
    return "(" + " + ".join(votes) + f") / {trees}D"


def train(spark: SparkSession, labelled: DataFrame | None = None, x: str = "x") -> str:
    """SQL over an array column x of FEATURES: the forest's probability of a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = (labelled if labelled is not None else labelled_findings(spark)).withColumn("x", F.expr(features("c", "before", "after")))
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", maxBins=64).fit(rows)
    return forest_sql(model.toDebugString, TREES, x)


def candidates(text: Column) -> Column:
    """array<struct<start, c, before, after>> of a whole text; start counts code points from 0."""
    with_gaps = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("cs"), F.split(text, CANDIDATE, -1).alias("gaps"))
    return F.when(text.rlike(CANDIDATE), with_gaps)


def with_findings(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """docs with found_ (candidates and the texts between them) and scores_, one probability a candidate."""
    forest = forest or train(docs.sparkSession, x="x")
    found = docs.withColumn("found_", candidates(F.col("text")))
    # a keyword may end the candidate before, as in aws_secret_access_key = "...", which then takes part in the context
    before = f"right(concat(IF(i > 0, found_.cs[i - 1], ''), found_.gaps[i]), {CONTEXT})"
    xs = features("c", before, f"left(found_.gaps[i + 1], {CONTEXT})")
    scored = found.withColumn("xs_", F.expr(f"transform(found_.cs, (c, i) -> {xs})"))
    return scored.withColumn("scores_", F.expr(f"transform(xs_, x -> {forest})")).drop("xs_")


def findings(docs: DataFrame, threshold: float = THRESHOLD, forest: str | None = None) -> DataFrame:
    """One row a secret: doc_id, start, size (code points), secret, probability."""
    scored = with_findings(docs.select("doc_id", "text"), forest).filter("found_ IS NOT NULL")
    # a start is what stands before it: whole blocks of gaps and candidates, then those of its own block
    sizes = "transform(found_.gaps, (g, i) -> length(g) + IF(i > 0, length(found_.cs[i - 1]), 0))"
    scored = scored.withColumn("sizes_", F.expr(sizes)).withColumn("blocks_", F.expr(f"transform(sequence(0, (size(sizes_) - 1) div {BLOCK}), b -> aggregate(slice(sizes_, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))"))
    starts = f"aggregate(slice(blocks_, 1, i div {BLOCK}), 0L, (a, x) -> a + x) + aggregate(slice(sizes_, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, x) -> a + x)"
    hits = F.expr(f"filter(transform(found_.cs, (c, i) -> struct(IF(scores_[i] >= {threshold}, {starts}, -1L) AS start, int(length(c)) AS size, c AS secret, scores_[i] AS probability)), f -> f.start >= 0)")
    return scored.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, threshold: float = THRESHOLD, forest: str | None = None) -> DataFrame:
    """docs with each secret replaced by REDACTED; texts without one stay as they are."""
    scored = with_findings(packed(docs, "text"), forest)
    clean = f"array_join(transform(found_.gaps, (g, i) -> concat(g, IF(i < size(found_.cs), IF(scores_[i] >= {threshold}, '{REDACTED}', found_.cs[i]), ''))), '')"
    text = F.expr(f"IF(exists(scores_, s -> s >= {threshold}), {clean}, text)")
    return scored.select(*[text.alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns])


def op4_secrets(spark, sf_dir):
    found = findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "size", F.sha2("secret", 256).alias("secret_sha256"), F.when(F.col("secret").rlike(PREFIX), F.regexp_extract("secret", r"^[A-Za-z]+", 0).substr(1, 4)).otherwise(F.lit("generic")).alias("kind"), F.round("probability", 4).alias("probability"))
