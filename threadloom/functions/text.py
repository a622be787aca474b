"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def shortened(text: Column, n: int) -> Column:
    """At most n characters, with dots where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def last_place(text: Column, mark: str) -> Column:
    """Place (from 1) of the last occurrence of a one-character mark, 0 for none."""
    back = F.instr(F.reverse(text), mark)
    return F.when(back == 0, 0).otherwise(F.length(text) - back + 1)


def cut_at_sentence(text: Column, n: int, share: float = 0.8) -> Column:
    """At most n characters, cut after the last full stop or line end if that lies beyond a share of n."""
    head = F.substring(text, 1, n)
    place = F.greatest(last_place(head, "."), last_place(head, "\n"))
    return F.when(F.length(text) <= n, text).when(place - 1 > n * share, F.substring(head, F.lit(1), place)).otherwise(head)


#: What stands at the end of a text that was cut.
CUT_NOTE = "\n\n[Message truncated due to length]"


def cut_for_embedding(text: Column, n: int = 6000) -> Column:
    """A text of at most n characters as it is, else what ``cut_at_sentence`` leaves of it, with a note."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut_at_sentence(text, n), F.lit(CUT_NOTE)))


def tokens_by_quarter(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("long")


def tokens_by_length(chars: Column) -> Column:
    """A token for every 3.5 characters."""
    return F.floor(chars / 3.5).cast("long")


def trace_ids(text: Column) -> Column:
    """What follows '# @trace-id:' marks."""
    return F.regexp_extract_all(text, F.lit(r"(?i)#\s*@trace-id:\s*(\S+)"), 1)


# Words of titles that don't count, and the marks that are cut off a word's ends.
TITLE_STOP = ("the", "a", "an", "is", "are", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "how", "what", "when", "where", "why", "which", "who", "not", "this", "that", "it", "its", "use", "using", "used")
TITLE_MARKS = r"""[.,!?;:()\[\]{}"'`\-_/\\]+"""


def title_words(title: Column, stop: tuple[str, ...] = TITLE_STOP, longer_than: int = 3) -> Column:
    """Distinct lower-case words of a title, without marks at their ends, stop words and short words."""
    words = F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, f"^{TITLE_MARKS}|{TITLE_MARKS}$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop)))


def expert_slug(message_id: Column) -> Column:
    """Episode slug within a chunk's message id, null if it is none."""
    return F.nullif(F.regexp_extract(message_id, r"^expert-(.+)-\d+$", 1), F.lit(""))


def path_from_folder(name: Column) -> Column:
    """The path that a folder's encoded name stands for: URL quoting undone, a leading dash as a slash, inner dashes kept."""
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^-", "/")


def fenced_json(text: Column) -> Column:
    """The outermost braces or brackets of a reply that may be fenced; null for none."""
    bare = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    braces, brackets = F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    first = F.when((brackets != "") & ((F.instr(bare, "[") < F.instr(bare, "{")) | (braces == "")), brackets).otherwise(braces)
    return F.nullif(first, F.lit(""))


def script_hash(text: Column) -> Column:
    """The 32-bit hash h * 31 + code, over a text's code points, as an unsigned number in base 10."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))


def capital(word: Column) -> Column:
    """The word with its first letter as one upper-case letter (ẞ for ß); a letter that has none stays."""
    first = F.substring(word, 1, 1)
    upper = F.when(first == "ß", "ẞ").when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
    return F.concat(upper, F.substring(word, F.lit(2), F.length(word)))
