"""R001 randomness, R002 timing, R003 GCM tags, C003 TLS, A002 tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.identifiers import assigned_name, is_security_target
from codesift.functions.text import extract, is_comment, matches, words
from codesift.operators.engine import Detector, FileFlag, Line, report


def _by_language(line: Line, python: str, script: str) -> Column:
    return F.when(line.is_python, python).otherwise(script)


def weak_randomness(line: Line) -> Column:
    text = line.text
    call = F.coalesce(*[F.when(matches(text, p), F.lit(name)) for p, name in P.WEAK_RANDOM])
    harmless_state = matches(text, P.USE_STATE) & ~is_security_target(
        extract(text, P.USE_STATE_NAME, 1)
    )
    window = line.window(2, 2)
    low = matches(text, P.ANALYTICS_ID) | matches(window, P.DRAFT_CONTEXT)
    fires = (
        call.isNotNull()
        & ~is_comment(text, P.COMMENT_COMMON)
        & ~matches(text, P.RANDOM_SAFE_LINE)
        & is_security_target(assigned_name(text))
        & ~harmless_state
        & ~matches(window, P.CRYPTO_GUARD)
    )
    variant = F.concat(F.when(low, "low-").otherwise("high-"), _by_language(line, "python", "script"))
    return F.when(fires, report("R001", F.when(low, "low").otherwise("high"), variant, call))


def _no_names() -> Column:
    empty = F.array().cast("array<struct<name: string, since: int>>")
    return F.struct(empty.alias("digests"), empty.alias("macs"))


def _digest_names() -> Column:
    """Names that hold a digest, with the line from which each does and from which it is a MAC.

    Assignments are folded in file order: a name is a MAC from the first line
    whose right side calls a MAC or uses a name that already is one.
    """
    lines = F.col("lines")

    def assignment(text: Column, index: Column) -> Column:
        name = F.concat(extract(text, P.DIGEST_ASSIGN, 1), extract(text, P.DIGEST_ASSIGN, 2))
        right_side = F.regexp_replace(text, P.rx(f"^.*?(?:{P.DIGEST_ASSIGN})"), "")
        return F.when(
            matches(text, P.DIGEST_CALL) & ~is_comment(text, P.COMMENT_COMMON) & (name != ""),
            F.struct(
                name.alias("name"),
                (index + 1).alias("since"),
                matches(text, P.HMAC_CALL).alias("direct"),
                words(right_side).alias("uses"),
            ),
        )

    def add_once(known: Column, item: Column, wanted: Column) -> Column:
        new = wanted & ~F.exists(known, lambda k: k["name"] == item["name"])
        entry = F.struct(item["name"].alias("name"), item["since"].alias("since"))
        return F.when(new, F.concat(known, F.array(entry))).otherwise(known)

    def step(acc: Column, item: Column) -> Column:
        inherits = F.exists(acc["macs"], lambda m: F.array_contains(item["uses"], m["name"]))
        return F.struct(
            add_once(acc["digests"], item, F.lit(True)).alias("digests"),
            add_once(acc["macs"], item, item["direct"] | inherits).alias("macs"),
        )

    assignments = F.array_compact(F.transform(lines, assignment))
    return F.aggregate(assignments, _no_names(), step)


_DIGEST_WORDS = ("digest", "createhmac", "hmac.new", "hashlib.")
_WEBHOOK_WORDS = (
    "verification_token", "webhook_", "_signature", "signature_token", "callback_token",
    "hook_secret", "hook_token",
)
DIGEST_NAMES = FileFlag("digest_names", _digest_names, _DIGEST_WORDS, lambda: _no_names())


def _digest_or_webhook() -> Column:
    text = F.array_join("lines", "\n")
    return matches(text, P.DIGEST_CALL) | matches(text, P.WEBHOOK_NAME)


def _uses_name(text: Column, names: Column, number: Column) -> Column:
    used = words(text)
    return F.exists(
        names, lambda n: (n["since"] <= number) & F.array_contains(used, n["name"])
    )


def timing_comparison(line: Line) -> Column:
    text = line.text
    names = line.flag("digest_names")
    window = line.window(2, 3)
    request_near = matches(window, P.REQUEST_VALUE)
    digest = (
        matches(text, P.DIGEST_CALL)
        | _uses_name(text, names["macs"], line.number)
        | (request_near & _uses_name(text, names["digests"], line.number))
    )
    webhook = matches(text, P.WEBHOOK_NAME) & request_near
    literal_only = (
        matches(text, P.LITERAL_COMPARE)
        & matches(text, P.WEBHOOK_LITERAL_COMPARE)
        & ~matches(text, P.REQUEST_VALUE)
    )
    fires = (
        matches(text, P.EQUALITY)
        & ~is_comment(text, P.COMMENT_COMMON)
        & (digest | webhook)
        & ~matches(window, P.CONSTANT_TIME_CALL)
        & ~matches(text, P.TYPEOF_GUARD)
        & ~literal_only
    )
    return F.when(fires, report("R002", "high", _by_language(line, "python", "script")))


def gcm_tag_length(line: Line) -> Column:
    fires = (
        line.is_script
        & matches(line.text, P.GCM_DECIPHER)
        & ~is_comment(line.text, P.COMMENT_SCRIPT)
        & ~matches(line.window(-1, 20), P.GCM_TAG_LENGTH)
    )
    return F.when(fires, report("R003", "high"))


def tls_disabled(line: Line) -> Column:
    text = line.text
    way = F.when(
        line.is_script,
        F.when(matches(text, P.TLS_REJECT_FLAG), "script").when(
            matches(text, P.TLS_REJECT_ENV), "env"
        ),
    ).when(line.is_python & matches(text, P.TLS_PYTHON), "python")
    guarded = matches(line.window(2, 2), P.TLS_DEV_GUARD)
    fires = way.isNotNull() & ~is_comment(text, P.COMMENT_COMMON)
    return F.when(
        fires,
        report(
            "C003",
            F.when(guarded, "low").otherwise("high"),
            F.concat(way, F.when(guarded, "-guarded").otherwise("")),
        ),
    )


def _token_library_unverified() -> Column:
    text = F.array_join("lines", "\n")
    return (F.col("language") == "python") | (
        matches(text, P.JWT_IMPORT) & ~matches(text, P.JWT_VERIFY)
    )


def unverified_token(line: Line) -> Column:
    fires = F.when(line.is_python, matches(line.text, P.JWT_DECODE_PYTHON)).when(
        line.is_script, line.flag("token_unverified") & matches(line.text, P.JWT_DECODE)
    )
    return F.when(fires, report("A002", "high", _by_language(line, "python", "script")))


def _not_test() -> Column:
    return ~F.col("is_test")


WEAK_RANDOMNESS = Detector(
    "R001",
    ("math.random", "uuid", "random.random", "random.randint", "random.choice", "random.uniform",
     "random.shuffle", "random.sample"),
    r"Math\.random|uuidv?1|uuid\.v1|random\.(?:random|randint|choice|uniform|shuffle|sample)\(",
    weak_randomness, before=2, after=2, allowed=lambda: ~F.col("is_benchmark"),
)
TIMING_COMPARISON = Detector(
    "R002", ("==", "!="), "[=!]=", timing_comparison, before=2, after=3,
    flags=(
        DIGEST_NAMES,
        FileFlag("secret_compared", _digest_or_webhook, _DIGEST_WORDS + _WEBHOOK_WORDS),
    ),
    gate=lambda: F.col("secret_compared"),
    file_words=_DIGEST_WORDS + _WEBHOOK_WORDS,
)
GCM_TAG = Detector(
    "R003", ("createdecipheriv",), "createDecipheriv", gcm_tag_length, after=20,
    allowed=_not_test,
)
TLS_DISABLED = Detector(
    "C003", ("rejectunauthorized", "node_tls_reject", "verify", "_create_unverified", "cert_none"),
    "rejectUnauthorized|NODE_TLS_REJECT|verify[^a-z0-9_(]|_create_unverified|CERT_NONE",
    tls_disabled, before=2, after=2, allowed=_not_test, keep_indent=True,
)
UNVERIFIED_TOKEN = Detector(
    "A002", ("jwt.decode",), r"jwt\.decode", unverified_token,
    flags=(FileFlag("token_unverified", _token_library_unverified, ("jwt.decode",)),),
    gate=lambda: F.col("token_unverified"), keep_indent=True,
)
