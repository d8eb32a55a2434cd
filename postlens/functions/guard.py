"""Personal-data, injection and answer checks as column expressions.

Patterns run with (?U) so that \\b, \\d and \\s are Unicode-aware, and with (?d) where "." and "$" may
only stop at a newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.fixed import (
    CARD_PATTERN,
    EMAIL_PATTERN,
    NRIC_PATTERN,
    PHONE_PATTERN,
    PII_MASKS,
    PROMPT_INJECTION,
    SQL_INJECTION,
)
from postlens.functions.staging import pin
from postlens.functions.text import is_blank

MIN_QUERY_LENGTH = 3
MAX_QUERY_LENGTH = 1000
MAX_ANSWER_LENGTH = 5000

_NO_STRINGS = "array<string>"


# Every number pattern needs four digits in a row and every address an "@"; texts without are not searched.
_DIGITS = "\\p{Nd}{4}"


def pii_first_matches(col: Column) -> dict[str, Column]:
    """First hit per kind of personal data, '' where there is none."""
    has_digits, has_at = col.rlike(_DIGITS), F.contains(col, F.lit("@"))

    def first(possible: Column, pattern: str) -> Column:
        return F.when(possible, F.regexp_extract(col, f"(?U){pattern}", 0)).otherwise("")

    return {
        "nric": first(has_digits, NRIC_PATTERN),
        "phone": first(has_digits, PHONE_PATTERN),
        "email": first(has_at, EMAIL_PATTERN),
        "card": first(has_digits, CARD_PATTERN),
    }


def pii_messages(hit: dict[str, Column]) -> Column:
    """One masked message per kind of personal data found."""
    messages = {
        "nric": F.concat(F.lit("NRIC found: "), hit["nric"], F.lit(" (redacted)")),
        "phone": F.concat(F.lit("Phone number found: "), F.substring(hit["phone"], 1, 4), F.lit("... (redacted)")),
        "email": F.concat(
            F.lit("Email found: "),
            F.substring(F.substring_index(hit["email"], "@", 1), 1, 3),
            F.lit("...@... (redacted)"),
        ),
        "card": F.concat(F.lit("Credit card found: ****-****-****-"), F.right(hit["card"], F.lit(4)), F.lit(" (redacted)")),
    }
    return F.array_compact(F.array(*[F.when(hit[kind] != "", message) for kind, message in messages.items()]))


def pii_violations(col: Column) -> Column:
    return pii_messages(pii_first_matches(col))


def with_pii(df: DataFrame, col: str) -> DataFrame:
    """Add has_nric, has_phone, has_email, has_card and the masked ``violations``; each pattern runs once."""
    hits = pii_first_matches(F.col(col))
    found = pin(df, **{f"_{kind}": hit for kind, hit in hits.items()})
    held = {kind: F.col(f"_{kind}") for kind in hits}
    return found.select(*df.columns, *[(hit != "").alias(f"has_{kind}") for kind, hit in held.items()], pii_messages(held).alias("violations"))


def pii_redact(col: Column) -> Column:
    masked = col
    for pattern, mask in PII_MASKS:
        masked = F.regexp_replace(masked, f"(?U){pattern}", mask)
    return F.when(col.rlike(_DIGITS) | F.contains(col, F.lit("@")), masked).otherwise(col)


def _pattern_hits(col: Column, patterns: list[str], label: str) -> Column:
    found = []
    for number, pattern in enumerate(patterns, 1):
        match = F.regexp_extract(col, f"(?imdU){pattern}", 0)
        message = F.concat(F.lit(f"{label} injection pattern {number}: '"), F.substring(match, 1, 50), F.lit("'"))
        found.append(F.when(match != "", message))
    return F.array_compact(F.array(*found))


def prompt_injection_hits(col: Column) -> Column:
    return _pattern_hits(col, PROMPT_INJECTION, "Prompt")


def sql_injection_hits(col: Column) -> Column:
    return _pattern_hits(col, SQL_INJECTION, "SQL")


def _verdict(passed: bool, severity: str, reason: str, violations: Column, sanitized: Column | None = None) -> Column:
    return F.struct(
        F.lit(passed).alias("passed"),
        F.lit(severity).alias("severity"),
        F.lit(reason).alias("reason"),
        violations.alias("violations"),
        (F.lit(None) if sanitized is None else sanitized).cast("string").alias("sanitized_input"),
    )


def _message(*parts: Column | str) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def input_verdict(col: Column) -> Column:
    """The first failing rule decides: empty, too short, too long, personal data, prompt, SQL."""
    size = F.length(col)
    pii, prompt, sql = pii_violations(col), prompt_injection_hits(col), sql_injection_hits(col)
    none = F.array().cast(_NO_STRINGS)
    return (
        F.when(
            is_blank(col),
            _verdict(False, "blocked", "Query cannot be empty", _message("Empty or whitespace-only query")),
        )
        .when(
            size < MIN_QUERY_LENGTH,
            _verdict(
                False,
                "blocked",
                f"Query too short (minimum {MIN_QUERY_LENGTH} characters)",
                _message("Query length: ", size, f" < {MIN_QUERY_LENGTH}"),
            ),
        )
        .when(
            size > MAX_QUERY_LENGTH,
            _verdict(
                False,
                "blocked",
                f"Query too long (maximum {MAX_QUERY_LENGTH} characters)",
                _message("Query length: ", size, f" > {MAX_QUERY_LENGTH}"),
            ),
        )
        .when(
            F.size(pii) > 0,
            _verdict(
                False,
                "blocked",
                "PII detected in query. Please remove personal information.",
                pii,
                pii_redact(col),
            ),
        )
        .when(
            F.size(prompt) > 0,
            _verdict(False, "blocked", "Potential prompt injection detected. Please rephrase your query.", prompt),
        )
        .when(
            F.size(sql) > 0,
            _verdict(False, "blocked", "Potential SQL injection detected. Please use plain language.", sql),
        )
        .otherwise(_verdict(True, "info", "Input validation passed", none))
    )


def output_verdict(answer: Column, cited: Column, context: Column) -> Column:
    """Check an answer against its context.

    ``answer`` is null where the response has none; ``cited`` and ``context`` are arrays of job ids and a
    null ``context`` skips the citation check. A length note alone blocks nothing unless sources exist.
    """
    note = F.when(
        F.length(answer) > MAX_ANSWER_LENGTH,
        F.concat(F.lit("Response truncated: "), F.length(answer).cast("string"), F.lit(f" > {MAX_ANSWER_LENGTH}")),
    )
    unknown = F.filter(cited, lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.array_contains(context, c))
    messages = F.concat(
        F.array_compact(F.array(note)),
        F.transform(unknown, lambda c: F.concat(F.lit("Hallucinated source: Job "), c, F.lit(" not in context"))),
    )
    checked = context.isNotNull() & (F.coalesce(F.size(cited), F.lit(0)) > 0)
    none = F.array().cast(_NO_STRINGS)
    return (
        F.when(
            answer.isNull(),
            _verdict(False, "blocked", "Invalid response structure", _message("Missing 'answer' field")),
        )
        .when(
            checked & (F.size(messages) > 0),
            _verdict(False, "warning", "Response cites jobs not in context", messages),
        )
        .when(
            is_blank(answer),
            _verdict(False, "blocked", "Empty response generated", _message("Answer is empty or whitespace-only")),
        )
        .otherwise(_verdict(True, "info", "Output validation passed", none))
    )
