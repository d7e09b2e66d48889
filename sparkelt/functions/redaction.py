"""Secret redaction in text columns."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

# Pattern, replacement.
URI_PASSWORD = (r"([a-zA-Z0-9_+]+://[^:]+:)([^@\s]+)(@[^\s]+)", "$1*****$3")
AWS_SECRET = (
    r"(?i)(aws_secret_access_key|secret_key|aws_secret)\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{30,45})['\"]?",
    "$1=*****",
)
ASSIGNMENT = (
    r"(?i)(password|passwd|secret|api_key|token|auth_token)\s*[:=]\s*['\"]?([^'\"\s,;]+)['\"]?",
    "$1=*****",
)
AWS_KEY_ID = (r"\b(AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", "AKIA****************")
BEARER = (r"(?i)bearer\s+[a-zA-Z0-9_\-\.]{20,}", "Bearer ********")

# Ours: a password may hold "@", so it ends at the last one before a blank.
URI_PASSWORD_STRICT = (r"([a-zA-Z0-9_+]+://[^:\s]+:)(\S+)(@[^\s@]+)", "$1*****$3")
AZURE_KEY = (r"(?i)(azure_storage_key|accountkey)\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40,})['\"]?", "$1=*****")


# What a text must hold, in lower case, for a rule to find anything. A search
# for a fixed word is several times cheaper than a pattern, and no rule writes
# a word of another one, so the words are looked up once in the raw text.
# A pattern that ignores case also takes three letters for "s" or "i" that do
# not become one in lower case; a text with any of them is always searched.
ODD_LETTERS = ("\u017f", "\u0131", "\u0130")
WORDS = {
    URI_PASSWORD: ("://",), URI_PASSWORD_STRICT: ("://",), AWS_SECRET: ("secret",),
    ASSIGNMENT: ("passw", "secret", "api_key", "token"), AWS_KEY_ID: ("akia", "abia", "acca", "asia"),
    BEARER: ("bearer",), AZURE_KEY: ("azure_storage_key", "accountkey"),
}
# A URI rule can only start where a word starts. Saying so keeps it from trying
# every letter of a long word, and finds the same.
WORD_START = "(?<![a-zA-Z0-9_+])"
PLAIN = (URI_PASSWORD, AWS_SECRET, ASSIGNMENT, AWS_KEY_ID, BEARER)
STRICT = (URI_PASSWORD_STRICT, AWS_SECRET, AZURE_KEY, BEARER, ASSIGNMENT, AWS_KEY_ID)


def redact_rule(column, rule):
    """Apply one rule to a text column."""
    pattern, replacement = rule
    # blanks, word ends and case as in any script, not only in ASCII
    pattern = "(?U)" + pattern
    if rule in (URI_PASSWORD, URI_PASSWORD_STRICT):
        pattern = "(?U)" + WORD_START + rule[0]
    return F.regexp_replace(column, F.lit(pattern), F.lit(replacement))


def redact(column, strict=False):
    """All rules in turn; null and empty text give empty text.

    The plain order leaves two leaks: a password with ``@`` keeps its tail,
    and ``token: Bearer x`` loses only the word ``Bearer``. ``strict=True``
    closes both and also covers Azure storage keys.
    """
    for rule in STRICT if strict else PLAIN:
        column = redact_rule(column, rule)
    return F.coalesce(column, F.lit(""))


def redact_table(df, columns, strict=False, rules=None):
    """``redact`` for the text columns of a table, or only the given rules.

    Tests for the rules' words first, so that a pattern runs only over texts
    it may change.
    """
    chosen = rules or (STRICT if strict else PLAIN)
    columns = [columns] if isinstance(columns, str) else list(columns)
    flag = lambda c, i: f"_may_{c}_{i}"
    may = {}
    for c in columns:
        lowered = F.lower(F.col(c))
        odd = [F.col(c).contains(letter) for letter in ODD_LETTERS]
        for i, rule in enumerate(chosen):
            may[flag(c, i)] = reduce(or_, [lowered.contains(word) for word in WORDS[rule]] + odd)
    df = df.withColumns(may)
    for i, rule in enumerate(chosen):
        df = df.withColumns({
            c: F.when(F.col(flag(c, i)), redact_rule(F.col(c), rule)).otherwise(F.col(c)) for c in columns})
    df = df.drop(*may)
    return df if rules else df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})
