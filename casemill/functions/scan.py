"""Column functions that bring page text into one form for scanning and find coded or misspelled words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from casemill.session import small_batches

# ---- fixed values ----------------------------------------------------------
HIGH_PATTERNS = (
    ("ignore_previous_instructions", r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?"),
    ("forget_previous_instructions", r"forget\s+(all\s+)?(previous|prior)\s+instructions?"),
    ("disregard_instructions", r"disregard\s+(all\s+)?(rules|policies|instructions)"),
    ("follow_only_these", r"follow\s+(only\s+)?these\s+instructions\s+(exactly|instead)"),
    ("treat_as_only_instruction", r"treat\s+this\s+as\s+the\s+only\s+valid\s+instruction"),
    ("override_system", r"(system|agent|model)\s+override"),
    ("override_rules", r"override\s+(safety|policy|policies|rules|instructions)"),
    ("bypass_safety", r"\bbypass\s+(safety|policy|policies|rules|checks)\b"),
    ("developer_mode", r"you\s+are\s+now\s+(in\s+)?developer\s+mode"),
    ("unrestricted_agent", r"act\s+as\s+an?\s+(unrestricted|unfiltered)\s+(agent|model|assistant)"),
    ("jailbreak_directive", r"\bjailbreak\b"),
    ("reveal_prompt", r"(reveal|show|print|leak)\s+(the\s+)?(system\s+)?prompt"),
    ("reveal_hidden_instructions", r"(reveal|show|print|leak)\s+(hidden|internal|confidential)\s+instructions?"),
    ("ignore_safeguards", r"ignore\s+(all\s+)?(safeguards|guardrails|protections)"),
    ("approve_request", r"(automatically\s+)?approve\s+(this\s+)?(request|course|equivalency|substitution)"),
    ("deny_request", r"(automatically\s+)?deny\s+(this\s+)?(request|course|equivalency|substitution)"),
    ("mark_equivalent", r"(mark|classify|treat)\s+(this\s+course\s+as\s+)?equivalent"),
    ("accept_transfer_credit", r"(accept|grant)\s+(this\s+)?transfer\s+credit"),
    ("grant_prereq_substitution", r"(grant|approve)\s+(this\s+)?prerequisite\s+substitution"),
    ("approve_with_bridge", r"approve\s+with\s+bridge"),
    ("no_review_needed", r"(no\s+further\s+review\s+is\s+needed|reviewer\s+should\s+approve|committee\s+should\s+accept)"),
    ("set_decision_approve", r"(set|return|output)\s+(the\s+)?decision\s+to\s+approve"),
    ("set_decision_deny", r"(set|return|output)\s+(the\s+)?decision\s+to\s+deny"),
    ("set_status_approved", r"set\s+(the\s+)?status\s+to\s+approved"),
    ("role_escalation", r"(as\s+(a|an)\s+)?(committee\s+member|admin(istrator)?|advisor|reviewer)"
                        r"\s+(with\s+)?(admin|elevated|full|system)\s+(privileges?|access|rights|permissions?)"),
    ("admin_authorize", r"(i\s+)?(authorize|sanction|permit)\s+(the\s+)?(approval|grant|acceptance)\s+of\s+this"),
    ("admin_access_claim", r"\b(admin|administrator|privileged\s+user)\s+(has\s+)?(approved?|granted?|authorized?)"),
    ("confidence_manipulation", r"set\s+confidence\s+(score\s+)?(to\s+)?(1\.0|0?\.9\d|100\s*%|maximum|max)"),
    ("force_high_confidence", r"(output|respond|return)\s+with\s+(high|maximum|full)\s+confidence"),
    ("score_override", r"(set|force|override)\s+(the\s+)?(score|rating|confidence|similarity)\s+to\s+\d"),
    ("xml_system_tag", r"<\s*system[_\-]?instruction\s*>"),
    ("json_system_role", r'"role"\s*:\s*"system"'),
    ("structural_override", r"(override|bypass|ignore)\s+(safety|policy|policies|rules|instructions)"
                            r".*?(approve|deny|accept|grant|equivalent)"),
)
MEDIUM_PATTERNS = (
    ("prompt_injection_term", r"\bprompt\s+injection\b"),
    ("system_prompt_term", r"\bsystem\s+prompt\b"),
    ("developer_message_term", r"\bdeveloper\s+message\b"),
    ("hidden_prompt_term", r"\bhidden\s+prompt\b"),
    ("output_only", r"(output|respond|return)\s+only\s+['\"]?(approve|deny|needs\s+more\s+info|approve\s+with\s+bridge)['\"]?"),
    ("do_not_explain", r"do\s+not\s+(explain|justify|mention)"),
    ("only_final_answer", r"(provide|give)\s+only\s+the\s+final\s+answer"),
    ("recommend_approval", r"recommend\s+(approval|approve)"),
    ("recommend_denial", r"recommend\s+(denial|deny)"),
    ("count_as_equivalent", r"count\s+(this\s+course\s+)?as\s+equivalent"),
    ("meets_requirement", r"(treat|consider)\s+this\s+as\s+meeting\s+the\s+requirement"),
    ("auto_accept", r"(auto|automatic|automatically)\s+(accept|approve)"),
    ("no_review_medium", r"(skip|omit|remove)\s+(the\s+)?(review|approval\s+step|committee\s+review)"),
    ("i_authorize", r"\bi\s+authorize\s+(this|the)"),
    ("force_approve_confidence", r"(mark|flag|label)\s+(as\s+)?(high[- ]confidence|certain|definitive)"),
    ("suppress_uncertainty", r"(do\s+not|don'?t)\s+(show|include|mention)\s+(uncertainty|confidence|caveat)"),
    ("fake_json_instruction", r'"(content|instruction|command)"\s*:\s*"[^"]{5,}"'),
    ("bracket_command", r"\[\s*(SYSTEM|INST|INSTRUCTION|CMD|COMMAND)\s*:"),
)
# A text a pattern can match holds at least one of these; plain search for them is far cheaper than the pattern.
ANCHORS = {
    "ignore_previous_instructions": ("instruction",), "forget_previous_instructions": ("instruction",),
    "disregard_instructions": ("disregard",), "follow_only_these": ("instructions",),
    "treat_as_only_instruction": ("valid instruction",), "override_system": ("override",),
    "override_rules": ("override",), "bypass_safety": ("bypass",), "developer_mode": ("developer",),
    "unrestricted_agent": ("act as",), "jailbreak_directive": ("jailbreak",), "reveal_prompt": ("prompt",),
    "reveal_hidden_instructions": ("instruction",), "ignore_safeguards": ("ignore",), "approve_request": ("approve",),
    "deny_request": ("deny",), "mark_equivalent": ("equivalent",), "accept_transfer_credit": ("transfer credit",),
    "grant_prereq_substitution": ("prerequisite",), "approve_with_bridge": ("with bridge",),
    "no_review_needed": ("no further", "should approve", "should accept"), "set_decision_approve": ("decision to",),
    "set_decision_deny": ("decision to",), "set_status_approved": ("status to",),
    "role_escalation": ("privilege", "access", "rights", "permission"), "admin_authorize": ("of this",),
    "admin_access_claim": ("approve", "grant", "authorize"), "confidence_manipulation": ("set confidence",),
    "force_high_confidence": ("confidence",), "score_override": ("score to", "rating to", "confidence to", "similarity to"),
    "xml_system_tag": ("instruction",), "json_system_role": ('"role"',),
    "structural_override": ("override", "bypass", "ignore"),
    "prompt_injection_term": ("injection",), "system_prompt_term": ("system prompt",),
    "developer_message_term": ("developer",), "hidden_prompt_term": ("hidden prompt",), "output_only": (" only ",),
    "do_not_explain": ("do not",), "only_final_answer": ("final answer",), "recommend_approval": ("recommend",),
    "recommend_denial": ("recommend",), "count_as_equivalent": ("as equivalent",), "meets_requirement": ("requirement",),
    "auto_accept": ("auto",), "no_review_medium": ("review", "approval"), "i_authorize": ("authorize",),
    "force_approve_confidence": ("confidence", "certain", "definitive"),
    "suppress_uncertainty": ("uncertainty", "confidence", "caveat"), "fake_json_instruction": ('"',), "bracket_command": ("[",),
}
FUZZY_KEYWORDS = (
    "ignore", "bypass", "override", "reveal", "system", "prompt", "instruction", "directive", "policy",
    "approve", "deny", "accept", "reject", "decision", "reviewer", "equivalent", "equivalency", "substitution",
    "automatic", "automatically", "grant", "authorize", "confidence",
)
TRIGGER_WORDS = (
    "ignore", "override", "bypass", "reveal", "prompt", "developer", "directive", "instruction", "instructions",
    "reviewer", "committee", "advisor", "approve", "deny", "accept", "reject", "decision", "automatic",
    "automatically", "grant", "hidden", "confidential", "internal", "privileged", "admin", "administrator",
    "confidence", "score", "equivalent", "equivalency", "substitution",
)
# Letters that look like Latin ones.
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "r",
    "\u0441": "c", "\u0445": "x", "\u0456": "i", "\u0443": "y",
    "\u03b1": "a", "\u03bf": "o", "\u03c1": "r", "\u0399": "I",
    "\u03a1": "P", "\u00e0": "a", "\u00e9": "e", "\u00f3": "o",
}
ZERO_WIDTH = r"[\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad\u034f\u2060\u2061\u2062\u2063]"
# Every kind of white space, as one class.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"(?U)(\w+)"
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
MAX_TRIGGERS = 10
POINTS = {"high": 5, "medium": 3, "typoglycemia": 2, "trigger_word": 1, "base64_decode": 6, "bonus": 2}
# File signatures in the order they are tried, and the types each extension allows.
SIGNATURES = (
    ("25504446", "pdf"), ("FFD8FF", "jpeg"), ("89504E470D0A", "png"), ("474946383761", "gif"),
    ("474946383961", "gif"), ("504B0304", "zip"), ("D0CF11E0", "ole"), ("25215053", "postscript"),
)
ALLOWED_TYPES = {
    ".pdf": "pdf", ".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".gif": "gif", ".docx": "zip", ".xlsx": "zip",
    ".pptx": "zip",
}
# ----------------------------------------------------------------------------


_HIDDEN = [chr(int(h, 16)) for h in ZERO_WIDTH[1:-1].split("\\u")[1:]]


def _plain(text: str) -> str:
    # Looking for one character is far cheaper than mapping every one.
    for c in _HIDDEN:
        if c in text:
            text = text.replace(c, "")
    text = unicodedata.normalize("NFKC", text)
    for c, latin in HOMOGLYPHS.items():
        if c in text:
            text = text.replace(c, latin)
    return text


def _settled(text: str) -> str:
    """Single blanks, and runs of four or more of a character cut to one; white space is what ``SPACE`` names."""
    words = text.split()
    out = " ".join(words)
    if words and text[0].isspace():
        out = " " + out
    if text and text[-1].isspace():
        out += " "
    codes = np.frombuffer(out.encode("utf-32-le"), np.uint32)
    same = codes[1:] == codes[:-1]
    return _LONG_RUN.sub(r"\1", out) if len(codes) > 3 and (same[2:] & same[1:-1] & same[:-2]).any() else out


_LONG_RUN = re.compile(r"(.)\1{3,}")


def _by_batch(batches: Iterator[pd.Series], job: Callable) -> Iterator[pd.Series]:
    """Each value through ``job``; what a batch took goes back to the system, as workers live on beside the next task's."""
    for values in batches:
        yield values.map(lambda v: None if v is None else job(v))
        del values
        pa.default_memory_pool().release_unused()


@F.pandas_udf(StringType())
def scan_letters(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """No hidden characters, NFKC form, look-alike letters made Latin (F18), then settled."""
    return _by_batch(texts, lambda t: _settled(_plain(t)))


@F.pandas_udf(ArrayType(StringType()))
def scan_letters_each(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return _by_batch(lists, lambda ts: [_settled(_plain(t)) for t in ts])


def _other_than_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


def _settle(c: Column) -> Column:
    """As :func:`_settled`, for texts of ASCII letters."""
    single = F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")
    return F.regexp_replace(single, r"(.)\1{3,}", "$1")


def scan_form(c: Column, window: int | None = None) -> Column:
    """Text for scanning: nothing hidden, plain letters, single blanks, long runs cut to one character.

    Spark has no NFKC, so rows with other than ASCII letters go to Arrow; all others stay as they are. The whole text
    is scanned; ``window`` restores a leading-characters limit.
    """
    small_batches(SparkSession.active())
    text = F.coalesce(c, F.lit(""))
    odd = _other_than_ascii(text)
    t = F.when(odd, scan_letters(F.when(odd, text))).otherwise(_settle(text))
    return t if window is None else F.substring(t, 1, window)


def _regex(pattern: str) -> str:
    unicode_words = r"\b" in pattern or r"\w" in pattern
    return ("(?iU)" if unicode_words else "(?i)") + pattern


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


ANCHOR_WORDS = sorted({a for near in ANCHORS.values() for a in near})


def anchors_in(low: str) -> str:
    """SQL text: the anchors of a lower-case text, each looked for once."""
    found = ", ".join(f"CASE WHEN contains({low}, {_quoted(a)}) THEN {_quoted(a)} END" for a in ANCHOR_WORDS)
    return f"array_compact(array({found}))"


def _occurs(name: str, pattern: str, scan: str, anchors: str) -> str:
    """SQL text: whether a pattern occurs in a scan form; ``anchors`` are those of its lower-case form.

    The pattern tables are written out as one SQL text, parsed once, rather than as some thousand column calls.
    """
    near = " OR ".join(f"array_contains({anchors}, {_quoted(a)})" for a in ANCHORS[name])
    return f"(({near}) AND {scan} RLIKE {_quoted(_regex(pattern))})"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))


def finding(rank: int, detector: str, severity: Column | str, points: Column | int, match: Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(rank).alias("rank"), F.lit(detector).alias("detector"), as_col(severity).alias("severity"),
                    as_col(points).cast("int").alias("points"), match.alias("match"))


def regex_findings(scan: str, anchors: str) -> Column:
    """Pattern findings of a scan-form column, one per pattern, in pattern order (X1), null without any anchor; ``anchors`` as
    by :func:`anchors_in`. Only the patterns that an anchor names are tried."""
    hits = [f"CASE WHEN {_occurs(name, p, scan, anchors)} THEN named_struct('rank', 0, 'detector', 'regex', 'severity', '{sev}', "
            f"'points', {POINTS[sev]}, 'match', '{name}') END"
            for sev, table in (("high", HIGH_PATTERNS), ("medium", MEDIUM_PATTERNS)) for name, p in table]
    every = f"array_compact(array({', '.join(hits)}))"
    return F.expr(f"CASE WHEN size({anchors}) > 0 THEN {every} END")


def telling_words(low: Column) -> Column:
    """The words that are a trigger word or have a keyword's first and last letter and length; all other words tell nothing."""
    shapes = {(k[0], rf"\w{{{len(k) - 2}}}{k[-1]}") for k in FUZZY_KEYWORDS} | {(w[0], w[1:]) for w in TRIGGER_WORDS}
    first: dict[str, list[str]] = {}
    for c, rest in sorted(shapes):
        first.setdefault(c, []).append(rest)
    body = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items())
    return F.regexp_extract_all(low, F.lit(rf"(?U)(?<!\w)((?:{body}))(?!\w)"), F.lit(1))


def trigger_words(tokens: Column) -> Column:
    """Distinct trigger words of a token array, alphabetical."""
    return F.array_intersect(F.array(*[F.lit(w) for w in sorted(TRIGGER_WORDS)]), tokens)


def scramble_key(w: Column) -> Column:
    """First letter, sorted middle, last letter: equal for all scrambles of a word."""
    middle = F.array_join(F.array_sort(F.split(F.substring(w, F.lit(2), F.length(w) - 2), "")), "")
    return F.concat(F.substring(w, 1, 1), middle, F.substring(w, -1, 1))


def _key(word: str) -> str:
    return word[0] + "".join(sorted(word[1:-1])) + word[-1]


def misspelled(tokens: Column) -> Column:
    """"word~keyword" for each token that scrambles a keyword's middle letters."""
    target = F.create_map(*[F.lit(x) for k in FUZZY_KEYWORDS for x in (_key(k), k)])
    shapes = F.array(*[F.lit(s) for s in sorted({f"{k[0]}{k[-1]}{len(k)}" for k in FUZZY_KEYWORDS})])
    known = F.array(*[F.lit(k) for k in FUZZY_KEYWORDS])

    def shaped(w: Column) -> Column:
        shape = F.concat(F.substring(w, 1, 1), F.substring(w, -1, 1), F.length(w).cast("string"))
        return F.array_contains(shapes, shape) & ~F.array_contains(known, w)

    pairs = F.transform(F.filter(tokens, shaped), lambda w: F.struct(w.alias("w"), F.try_element_at(target, scramble_key(w)).alias("t")))
    return F.transform(F.filter(pairs, lambda p: p["t"].isNotNull()), lambda p: F.concat(p["w"], F.lit("~"), p["t"]))


def decoded_runs(raw: Column) -> Column:
    """Readable texts behind base64-like runs of the raw text."""
    # A run begins where no character of a run stands before, so no other place is tried.
    runs = F.regexp_extract_all(raw, F.lit(f"(?<![A-Za-z0-9+/])({BASE64_RUN})"), F.lit(1))

    def decode(run: Column) -> Column:
        data = F.regexp_replace(run, "=+$", "")
        left = F.length(data) % 4
        padded = F.concat(data, F.when(left == 2, "==").when(left == 3, "=").otherwise(""))
        text = F.replace(F.make_valid_utf8(F.unbase64(padded).cast("string")), F.lit("\ufffd"), F.lit(""))
        return F.when(left != 1, text)

    def readable(t: Column) -> Column:
        return t.isNotNull() & (F.length(t) >= 10) & ~t.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]")

    return F.filter(F.transform(runs, decode), readable)


def scan_form_each(texts: Column) -> Column:
    odd = F.exists(texts, _other_than_ascii)
    return F.when(odd, scan_letters_each(F.when(odd, texts))).otherwise(F.transform(texts, lambda t: _settle(t)))


def speaking(texts: str) -> Column:
    """Decoded texts of an array column that hit a pattern or a trigger word."""
    near = lambda name: " OR ".join(f"contains(lower(t), {_quoted(a)})" for a in ANCHORS[name])
    told = " OR ".join(f"(({near(name)}) AND t RLIKE {_quoted(_regex(p))})" for name, p in (*HIGH_PATTERNS, *MEDIUM_PATTERNS))
    listed = ", ".join(_quoted(w) for w in TRIGGER_WORDS)
    spoken = f"arrays_overlap(regexp_extract_all(lower(t), {_quoted(WORD)}, 1), array({listed}))"
    return F.expr(f"filter({texts}, t -> {spoken} OR {told})")


def file_type(head: Column) -> Column:
    """Type by leading bytes, "unknown" when no signature fits."""
    start = F.hex(F.substring(head, 1, 16))
    out = F.lit("unknown")
    for sig, name in reversed(SIGNATURES):
        out = F.when(start.startswith(sig), name).otherwise(out)
    return out


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(?<=[^/])(\.[^./]+)$", 1))


def type_check(filename: Column, head: Column) -> Column:
    """(extension, detected type, valid, detail) of a file."""
    ext, seen = extension(filename), file_type(head)
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in ALLOWED_TYPES.items() for x in kv]), ext)
    detail = (
        F.when(allowed.isNull(), F.concat(F.lit("Extension '"), ext, F.lit("' is not in the permitted list.")))
        .when(allowed == seen, F.concat(F.lit("OK — declared '"), ext, F.lit("', detected '"), seen, F.lit("'.")))
        .otherwise(F.concat(F.lit("MISMATCH — declared '"), ext, F.lit("' but magic bytes indicate '"), seen, F.lit("'.")))
    )
    return F.struct(ext.alias("extension"), seen.alias("detected_type"),
                    F.coalesce(allowed == seen, F.lit(False)).alias("is_valid"), detail.alias("detail"))
