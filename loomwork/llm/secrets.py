"""Secret scans: candidates by pattern, false positives out by a random forest; SQL functions and Spark ML only.

A candidate is a long run of token characters, or any value of six or more characters after
a secret word or in the user part of a URL.  The forest sees its length, character
transitions, dictionary coverage, path marks and neighbouring words, and is trained on
labelled findings that a seeded generator writes (``LABELLED`` of them).
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, free_name, let, stash

#: Labelled findings that the forest is fitted on (a documented bound), trees and depth.
LABELLED, TREES, DEPTH, SEED = 4000, 24, 8, 8
#: Code points of context that count as neighbours.
BEFORE, AFTER = 40, 16
#: Gaps and values that BEFORE can reach over (a value has six characters or more), and numbers of a run of sums.
REACH, RUN = 14, 32
#: Code points of a piece of text that is masked at once.
PIECE = 4096
#: Documents with secrets up to which their table is broadcast by redact(); beyond, it is shuffled.
BROADCAST_ROWS = 100_000
#: A value may follow '='; padding ends a run only where no token character follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?"
#: Common words of identifiers, paths and placeholders.
DICTIONARY = (
    "abcdef account action admin after api app archive array auth backup base batch before bin bit block body build byte "
    "cache call change char check class client cloud code column com common config connect content control copy core count "
    "create current data date default delete demo dev directory document domain dummy enable end entry error event example "
    "false fake field file filter find first flag folder format from function get global group handle hash header home host "
    "html http image import index info input insert item java key kind label last length level library license link list "
    "local lock log login main manager map master max message method min mode model module mount name network new node null "
    "number object open option order output owner page parent part password path placeholder point port private process "
    "project property public query read record release remote remove replace report request response result return root row "
    "sample script search secret section select server service session set shared size source start state status stop store "
    "stream string system table target task temp test text this time title token tool total true type unit update upload url "
    "user util value version view web with word work write xxxx your"
).split()
SECRET_WORDS = (
    r"(?iu)(token|secret|passw|pass.?phrase|passcode|pwd|api.?key|access.?key|credential|auth|bearer|private"
    r"|kennwort|geheimnis|zugangsschlüssel|zugangsdaten|contraseña|contrasena|clave.?(?:secreta|privada|de.?acceso)|mot.?de.?passe|mdp\b|jeton|clé.?(?:secrète|privée|d.?accès))"
)
HARMLESS_WORDS = r"(?i)(sha|commit|md5|digest|checksum|hash|uuid|revision|example|sample|dummy|placeholder|fixture|etag|blob|integrity|font|base64|image)"
#: Programs that take a password behind -p.
CLIENTS = "mysql|mysqldump|mysqladmin|mariadb|sshpass|mongo|mongosh"


#: What stands between a value and the secret word before it: the word's end, then a sign or spaces.
NAMED = SECRET_WORDS.replace("(?iu)(", "(?iu:").replace(".?", "[_ .-]?") + r"""[\p{L}\p{N}_.\[\]\-]{0,24}(?:["'`]?\]?\s{0,3}(?::=|=>|[=:])\s{0,3}|\s{1,3}(?:(?:is|was|ist|war|lautet|es|era|est)\s{1,2})?)["'`]?"""


def _assigned() -> str:
    """The pattern of values after secret words and in URLs; values that CANDIDATE finds with the same ends are left out."""
    named = r"""(?<=[\s=:>"'`])(?=\S{6})(?<=""" + NAMED + ")"
    # six characters at least, then possessive runs: a repeated alternation recurses once a character in Java's matcher
    quoted = [rf"(?<={q})(?!{CANDIDATE}{q})(?=(?:[^\s{q}\\]|\\\S){{6}})[^\s{q}\\]*+(?:\\\S[^\s{q}\\]*+)*+(?={q})" for q in "\"'`"]
    url = r"(?<=[?&][\w.\[\]\-]{1,40}=)"
    pair = r"(?<=;\s?[\w.\[\]\-]{1,40}=)"
    in_url = url + rf"""(?!{CANDIDATE}(?:[&#\s"'`<>]|$))[^\s&#"'`<>]{{6,}}"""
    in_list = pair + rf"""(?!{CANDIDATE}(?:[;\s"'`<>]|$))[^\s;"'`<>]{{6,}}"""
    end = r""",;.)\]}>"'`"""
    bare = url.replace("?<=", "?<!") + pair.replace("?<=", "?<!") + rf"""(?:(?<!["'`])|(?!\S*["'`]))(?!{CANDIDATE}[{end}]*(?:\s|$))[^\s"'`]\S{{4,}}[^\s{end}]"""
    password = rf"(?<=:)(?<=[A-Za-z0-9+.\-]{{2,12}}://[^\s/@:]{{0,128}}:)(?!{CANDIDATE}@)"
    user = r"(?<=://)(?=[^\s/@:]{6,}@)"
    shell = rf"""(?:(?<=\s-p)(?<=\b(?:{CLIENTS})\b[^\n]{{0,60}}\s-p)|(?<=\s(?:-u|--user)[ =]["']?[^\s:"']{{1,40}}:))(?!{CANDIDATE}["']?(?:\s|$))[^\s"'`]{{6,}}"""
    return shell + "|" + named + "(?:" + "|".join([*quoted, in_url, in_list, bare]) + ")|(?:" + password + "|" + user + r""")[^\s"'`<>]{6,}(?=@[\w\[])"""


ASSIGNED = _assigned()
FOUND = "array<struct<value:string,before:string,after:string,start:int>>"


def candidates(df: DataFrame, text_col: str) -> Column:
    """Array of (value, before, after, start) for a text; null and empty texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat(_matches(text, CANDIDATE), F.when(text.rlike(SECRET_WORDS + r"|://|\s-p\S|\s(?:-u|--user)[ =]"), _matches(text, ASSIGNED)).otherwise(F.array().cast(FOUND)))


def running_sums(numbers: Column, depth: int = 4) -> Column:
    """Sums of an array of integers up to each place, in time that grows with its length.

    Runs of RUN numbers are summed one by one; the sums of the runs are added up in the
    same way, ``depth`` times over (RUN ** depth numbers).
    """
    run = lambda part: F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.aggregate(F.slice(part, F.lit(1), n), F.lit(0), lambda x, y: x + y))
    if not depth:
        return run(numbers)

    def cut(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(held), F.lit(RUN))
        return let(F.transform(starts, lambda at: run(F.slice(held, at, F.lit(RUN)))), join)

    def join(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.element_at(r, -1))
        later = lambda sums: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.when(i > 0, F.get(sums, i - 1)).otherwise(0))))
        return F.when(F.size(runs) > 1, let(running_sums(ends, depth - 1), later)).otherwise(F.flatten(runs))

    return let(numbers, cut)


def _matches(text: Column, pattern: str) -> Column:
    """Every match with what stands before and after it; linear in their number."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(c: Column) -> Column:
        values, gaps = c["values"], c["gaps"]
        pairs = F.transform(values, lambda v, i: F.struct(v.alias("value"), F.get(gaps, i).alias("gap")))
        ends = running_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"])))
        # ends of gaps and values in turn: what lies before may reach over earlier values
        tails = F.flatten(F.transform(pairs, lambda p: F.array(F.right(p["gap"], F.lit(BEFORE)), F.right(p["value"], F.lit(BEFORE)))))
        return let(F.struct(values.alias("values"), gaps.alias("gaps"), ends.alias("ends"), tails.alias("tails")), told)

    def told(c: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            least = F.greatest(2 * i - REACH, F.lit(0))
            before = F.right(F.array_join(F.slice(c["tails"], least + 1, 2 * i + 1 - least), ""), F.lit(BEFORE))
            after = F.substring(F.concat(F.get(c["gaps"], i + 1), F.coalesce(F.get(c["values"], i + 1), F.lit(""))), F.lit(1), F.lit(AFTER))
            return F.struct(v.alias("value"), before.alias("before"), after.alias("after"), (F.get(c["ends"], i) - F.length(v)).alias("start"))

        return F.transform(c["values"], one)

    return let(cut, lambda c: F.when(F.size(c["values"]) > 0, placed(c)).otherwise(F.array().cast(FOUND)))


def features() -> dict[str, Column]:
    """What the forest sees of (value, before, after)."""
    v, low, n = F.col("value"), F.lower("value"), F.length("value")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    flag = lambda c: c.cast("double")
    return {
        "length": n.cast("double"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40)),
        "digits": count(v, "[0-9]") / n,
        "capitals": count(v, "[A-Z]") / n,
        "symbols": count(v, r"[^A-Za-z0-9]") / n,
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "digit_turns": (count(v, "[0-9](?=[A-Za-z])") + count(v, "[A-Za-z](?=[0-9])")) / n,
        "case_turns": (count(v, "[a-z](?=[A-Z])") + count(v, "[A-Z](?=[a-z])")) / n,
        "vowel_turns": (count(low, "[aeiou](?=[b-df-hj-np-tv-z])") + count(low, "[b-df-hj-np-tv-z](?=[aeiou])")) / n,
        "repeats": count(low, r"(.)(?=\1)") / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "path_marks": count(v, "/") / n,
        "in_path": flag(F.col("before").rlike(r"([/\\.@]|://\S*)$") | F.col("after").rlike(r"^[/\\.@]\w")),
        "uuid": flag(v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "known_prefix": flag(v.rlike("^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abpr]-|sk[-_]|eyJ|AIza)")),
        "secret_word": flag(F.concat(F.col("before"), v).rlike(SECRET_WORDS)),
        "harmless_word": flag(F.concat(F.col("before"), v).rlike(HARMLESS_WORDS)),
        "assigned": flag(F.col("before").rlike(r"""[=:]\s*["']?$""")),
        "code_marks": count(v, r"[(){}<>$\[\]]") / n,
        "named": flag(F.col("before").rlike("(?:" + NAMED + ")$")),
        "shell": flag(F.col("before").rlike(rf"""\b(?:{CLIENTS})\b.*\s-p$|\s(?:-u|--user)[ =]["']?[^\s:"']+:$""")),
        "link": flag(F.col("before").rlike(r"https?://\S*/$") & F.col("after").rlike(r"^(?:[/?#.,)\s]|$)")),
        "encoded": flag(F.col("before").rlike(r"(?i)base64,\s*$|integrity[\"' :=]*$") | v.rlike("^sha(1|256|384|512)-")),
        "user_part": flag(F.col("before").rlike(r"://[^\s/@]*$") & F.col("after").rlike("^@")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
    }


def labelled_findings(n: int = LABELLED, seed: int = SEED) -> list[dict]:
    """Generated findings, half of them secrets: value, before, after, secret, and the text they stand in with their start."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "er en ch de ei in te ge un ich tion th an re ou ent le la con ment qu os ar al es ado ing ness ble ly ed is".split()
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 5)))
    prose = lambda: " ".join(name() for _ in range(r.randint(2, 7))) + r.choice([" ", ". ", "\n", ", "])
    word = lambda: r.choice(DICTIONARY)
    keys = ["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "Authorization", "credential", "access_token", "aws_secret_access_key", "passwd", "db_password", "passphrase", "pwd", "Passwort", "Kennwort", "contraseña", "clave secreta", "mot de passe", "jeton"]
    secrets = [
        lambda: some(hexa, r.choice([32, 40, 48, 64])), lambda: some(alnum, r.randint(20, 64)), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36),
        lambda: "sk_live_" + some(alnum, 24), lambda: some(alnum + "+/", 43) + "=", lambda: "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24), lambda: "eyJ" + some(alnum + "_-", 60), lambda: "glpat-" + some(alnum + "_-", 20),
    ]
    harmless = [
        (lambda: some(hexa, r.choice([32, 40, 64])), lambda: r.choice(["commit ", "sha256:", "sha1 = ", "md5sum ", "checksum: ", "revision ", "etag: \"", "blob "])),
        (lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: r.choice(["uuid = ", "id: ", "request ", "session "])),
        (lambda: "".join(r.choice(syllables) for _ in range(r.randint(6, 12)))[:60].ljust(16, "e"), prose),
        (lambda: "/".join(word() for _ in range(r.randint(4, 7))).ljust(16, "s"), lambda: r.choice(["in /", "see ", "file: ", "https://host.example/", "path = "])),
        (lambda: r.choice("x0*aA").replace("*", "x") * r.randint(16, 40), lambda: r.choice(keys) + r.choice([" = \"", ": ", "="])),
        (lambda: r.choice(["your", "example", "dummy", "placeholder", "test"]) + r.choice("-_") + "_".join([word(), r.choice(keys), r.choice(["here", "value", "goes_here", "1234567890"])]), lambda: r.choice(keys) + r.choice([" = \"", ": ", "="])),
        (lambda: "_".join(word() for _ in range(r.randint(3, 5))).ljust(16, "s"), lambda: r.choice([prose(), "call ", "def ", "return "])),
        (lambda: word() + "".join(word().title() for _ in range(r.randint(3, 5))) + r.choice(["Manager", "Factory", "Token"]), lambda: r.choice([prose(), "class ", "new ", "import "])),
        (lambda: some(string.digits, r.randint(16, 20)), lambda: r.choice([prose(), "order ", "number ", "card ", ""])),
        (lambda: r.choice("-_=").replace("=", "-") * r.randint(16, 60), prose),
        (lambda: some(hexa, r.choice([32, 40, 64])), lambda: r.choice(["commit=", "sha256=", "https://host.example/get?rev=", "https://host.example/get?a=1&checksum=", "GIT_COMMIT="])),
        (lambda: "sha" + r.choice(["256", "384", "512"]) + "-" + some(alnum + "+/", r.choice([43, 64, 86])) + r.choice(["=", "==", ""]), lambda: r.choice(["integrity: ", "\"integrity\": \"", "integrity=\"", "resolution ", "  "])),
        (lambda: some(alnum + "+/", r.randint(40, 90)), lambda: r.choice(["data:image/png;base64,", "url(data:font/woff2;base64,", "data:application/font;base64,", "src=data:image/gif;base64,"])),
        (lambda: some(alnum + "_-", r.choice([11, 22, 33, 44])).ljust(16, "e"), lambda: r.choice(["https://docs.host.example/document/d/", "https://host.example/watch/", "https://host.example/file/", "https://host.example/a/b/"])),
        (lambda: "_".join(word() for _ in range(r.randint(4, 6))).ljust(16, "s"), lambda: r.choice(["mode=", "NAME=", "https://host.example/get?page=", "https://host.example/?a=1&label="])),
    ]
    marks = "!@#$%^*?.,+~"
    passwords = [
        lambda: word() + some(string.digits, r.randint(1, 4)) + r.choice(marks) + some(string.ascii_lowercase, r.randint(0, 3)), lambda: word().title() + some(string.digits, r.randint(2, 4)), lambda: some(alnum + marks, r.randint(7, 15)) + r.choice(string.ascii_lowercase),
        lambda: some(alnum, r.randint(7, 15)), lambda: r.choice("STPM") + some("34015", 1) + name() + some(string.digits, 2), lambda: name() + some(string.digits, r.randint(1, 3)) + some(marks, 1) + name(), lambda: some(string.ascii_letters + "0123456789", 5) + r.choice(marks) + some(alnum, r.randint(2, 30)),
    ]
    plain = [
        (lambda: name().ljust(6, "e"), lambda: r.choice(keys) + r.choice([" ", " ", " is ", ": ", " of "])), (lambda: word().ljust(6, "s"), lambda: r.choice(keys) + r.choice([" ", ": ", " = "])),
        (lambda: r.choice(["${", "$(", "<", "{{"]) + r.choice(keys).upper() + r.choice(["}", ")", ">", "}}"]), lambda: r.choice(keys) + r.choice(["=", ": ", " = \""])),
        (lambda: r.choice(["get", "read", "load"]) + word().title() + r.choice(["()", "(name)", "(self)"]), lambda: r.choice(keys) + r.choice([" = ", "="])), (lambda: word() + "." + word() + r.choice(["", "[0]", "()"]), lambda: r.choice(keys) + r.choice([" = ", "="])),
        (lambda: r.choice(["********", "xxxxxxxx", "changeme", "required", "optional", "string", "undefined", "<hidden>"]), lambda: r.choice(keys) + r.choice([": ", "=", " = \""])), (lambda: some(string.digits, r.randint(2, 5)) + "/" + word() + "?" + word() + "=", lambda: "http://host.example:"),
    ]
    out = []

    def add(lead: str, value: str, tail: str, secret: float) -> None:
        out.append({"value": value, "before": lead[-BEFORE:], "after": tail[:AFTER], "secret": secret, "text": lead + value + tail, "start": len(lead)})

    for k in range(n):
        if k % 6 == 1:  # short values, with any characters
            if r.random() < 0.15:  # on a command line
                lead, tail = r.choice(["mysql -h db -u root -p", "mysqldump -p", "sshpass -p", "curl -u admin:", "curl --user ci:", "wget --user=me:"]), ""
            elif r.random() < 0.3:
                lead, tail = r.choice(["postgres", "https", "mysql", "ftp", "redis"]) + "://" + r.choice([word(), name(), ""]) + ":", "@" + r.choice(["db", "host.example", "localhost:5432", "10.0.0.1"]) + r.choice(["", "/", "/" + word()])
            else:
                quote = r.choice(["\"", "'", "", "\""])
                key, sign = r.choice([r.choice(keys), r.choice(keys).upper()]), r.choice([" = ", "=", "=", ": ", ":", " := ", " ", " is ", " lautet ", " es ", " est "])
                if quote and r.random() < 0.3:
                    key, sign = quote + key + quote, ": "
                lead, tail = r.choice(["", "", "--"]) + key + sign + quote, quote
            add(r.choice([prose(), "", prose()]) + lead, r.choice(passwords)().ljust(6, "7"), tail + r.choice([" ", "\n", " "]) + prose(), 1.0)
        elif k % 6 == 2:
            make, lead = r.choice(plain)
            before = lead()
            add(r.choice([prose(), ""]) + before, make(), ("\"" if before.endswith("\"") else "@" if "://" in before else "") + " " + prose(), 0.0)
        elif k % 2:
            quote = r.choice(["\"", "'", "", "", "\""])
            key, sign = r.choice([r.choice(keys), r.choice(keys).upper()]), r.choice([" = ", "=", "=", ": ", ":", " := "])
            if r.random() < 0.15:  # a parameter of a URL
                lead, quote, sign = "https://host.example/" + r.choice(["", "cb", "v1/get"]) + r.choice(["?", "?a=1&", "?page=2&"]), "", "="
                tail = r.choice(["&a=1", "&state=" + word(), "#top", ""])
            else:
                lead, tail = "", ""
            add(r.choice([prose(), "", prose()]) + lead + key + sign + quote, r.choice(secrets)(), quote + tail + r.choice([" ", "\n", " ", "### "]) + prose(), 1.0)
        else:
            make, lead = r.choice(harmless)
            before = lead()
            add(r.choice([prose(), ""]) + before, make(), ("\"" if before.endswith("\"") else "") + r.choice([" ", ". ", ",", "\n", "### "]) + prose(), 0.0)
    return out


def _assembled(df: DataFrame) -> DataFrame:
    made = features()
    return VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="features", handleInvalid="keep").transform(df.withColumns({f"f_{k}": F.coalesce(c, F.lit(0.0)) for k, c in made.items()}))


def drawn(spark: SparkSession, findings: list[dict]) -> DataFrame:
    """The candidates of the texts of generated findings: value, before, after, secret (1 if six or more characters are the secret's)."""
    table = _rows(spark, [{"text": f["text"], "from": f["start"], "to": f["start"] + len(f["value"]), "is": f["secret"]} for f in findings], "text string, from int, to int, is double")
    found = table.withColumn("c", F.explode(candidates(table, "text"))).select("c.*", "from", "to", "is")
    shared = F.least(F.col("start") + F.length("value"), F.col("to")) - F.greatest("start", "from")
    return found.select("value", "before", "after", F.when(shared >= 6, F.col("is")).otherwise(0.0).alias("secret"))


def _rows(spark: SparkSession, findings: list[dict], schema: str) -> DataFrame:
    """Findings as rows, in order, in one partition; their texts are no part of the plan, which Spark keeps and prints again and again."""
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in findings], schema).coalesce(1)


def train(spark: SparkSession, findings: list[dict] | None = None) -> RandomForestClassificationModel:
    """A forest from labelled findings; if none are given, from the candidates of the generated texts.

    What it is fitted on is written first: the fit reads it several times, by a small plan.
    """
    table = _rows(spark, findings, "value string, before string, after string, secret double") if findings else drawn(spark, labelled_findings())
    seen = stash(_assembled(table).select("secret", "features"), "labelled")
    # one partition, whatever the cores: the forest draws its samples by partition
    model = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(seen.coalesce(1))
    discard(seen)
    return model


def scan(df: DataFrame, model: RandomForestClassificationModel | None = None, carried: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate of each whole text: carried columns, start, length, value, probability, is_secret.

    start counts code points from 0.  Texts without candidates give no row; repeated rows
    give their findings each; carried columns must not have names of the result.
    """
    model = model or train(df.sparkSession)
    found = df.select(*carried, F.explode(candidates(df, text_col)).alias("__c")).select(*carried, "__c.*")
    scored = model.transform(_assembled(found)).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*carried, F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), "value", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """df with the places that the scan takes for secrets replaced by ``mask``; all rows and columns stay.

    Only those places change: the same value elsewhere stays if the scan lets it pass.
    Places that overlap or touch one that began before become one mask.  Rows that repeat
    an id and a text have the same places; null and empty texts stay.  Names never clash.
    """
    h1, h2, spans, c1, c2 = (free_name(n, *df.columns) for n in ("__h1", "__h2", "__spans", "__c1", "__c2"))
    # a text is known by its id and 128 bits
    named = df.withColumns({h1: F.xxhash64(F.col(id_col), F.lit(1), F.col(text_col)), h2: F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col))})
    found = scan(named.select(h1, h2, text_col), model, (h1, h2), text_col).filter("is_secret").select(F.col(h1).alias(c1), F.col(h2).alias(c2), "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    # a place that crosses a border of pieces goes on in the next one, without another mask
    piece = F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("stop") - 1) / PIECE)))
    cut = found.select(c1, c2, "start", "stop", piece.alias("piece"))
    inner = F.struct(
        F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0)).cast("int").alias("from"), F.least(F.col("stop") - F.col("piece") * PIECE, F.lit(PIECE)).cast("int").alias("to"),
        (F.col("start") >= F.col("piece") * PIECE).alias("begins"),
    )
    by_piece = cut.groupBy(c1, c2, "piece").agg(F.sort_array(F.collect_list(inner)).alias("inner"))
    by_text = stash(by_piece.groupBy(c1, c2).agg(F.sort_array(F.collect_list(F.struct(F.col("piece").cast("int").alias("piece"), "inner"))).alias(spans)), "secrets")
    side = F.broadcast(by_text) if by_text.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by_text
    joined = named.join(side, (F.col(h1) == F.col(c1)) & (F.col(h2) == F.col(c2)), "left")
    clean = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_masked(F.col(text_col), F.col(spans), mask))
    return joined.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in df.columns])


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text, cut in pieces, with the places of each piece (see redact) replaced."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def fill(piece: Column, inner: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fresh = (x["from"] > acc["at"]) | ((x["from"] == 0) & (acc["at"] == 0))
            gap = F.substring(piece, acc["at"] + 1, F.greatest(x["from"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(acc["at"], x["to"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh & x["begins"], F.lit(mask)).otherwise("")).alias("out"))

        return F.aggregate(inner, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.length(piece))))

    def each(piece: Column, i: Column) -> Column:
        mine = F.get(F.filter(spans, lambda s: s["piece"] == i), F.lit(0))["inner"]
        return let(mine, lambda inner: F.when(inner.isNull(), piece).otherwise(fill(piece, inner)))

    return F.array_join(F.transform(pieces, each), "")
