"""Rule-ordered token classes: the first class whose pattern fits a whole word decides what tokens the word gives."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkquill.functions.text import STRIPPED, let, lowered, split_words, strip_word

# Classes in the order in which they are tried, with their patterns and actions.
CLASSES = [
    ("alpha_digit", r"[a-zA-Z]+-[0-9]+", "split"),
    ("date1", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "date"),
    ("date2", r"[0-9]+-[0-9]+-[0-9]-", "none"),
    ("date3", r"[a-zA-Z]{3}-[0-9]+-[0-9]+", "date"),
    ("date4", r"[0-9]{2}/[0-9]{2}/[0-9]{2}", "date"),
    ("digit_alpha", r"[0-9]+-[a-zA-Z]+", "split"),
    ("dot_notes", r"[a-zA-Z]+\.[a-zA-Z.]+", "strip"),
    ("ip", r"([0-9]{1,3}\.){3}[0-9]{1,3}", "ip"),
    ("dots", r"[0-9,]*\.[0-9]+", "keep"),
    ("email", r"([a-zA-Z.]+@)+[a-z.]+", "email"),
    ("hyphen", r"[a-zA-Z]*(-[a-zA-Z]*){1,3}", "split"),
    ("integer", r"[0-9]{1,3}(,[0-9]{3})*", "strip"),
    ("monetory", r"\$[0-9\.,]+", "strip"),
    ("url3", r".+\.(com|org|cn|us|edu).+", "keep"),
    ("file", r".+\.(pdf|html|sh|txt|doc|zip|exe|rar|avi|xls|dll|gif|jpg|pic|png|avi|bat)", "split"),
    ("word", r"[a-zA-Z]+", "keep"),
    ("digits", r"[0-9]+", "keep"),
    ("paragraph", r"(§|¶)+[a-z0-9\.-]+", "paragraph"),
    ("url", r"https?://.+", "keep"),
    ("url2", r"www\..+", "keep"),
    ("digit_alpha_mixes", r"[0-9a-zA-Z]+-[0-9a-zA-Z-]+", "split"),
    ("no_hyphen_mixes", r"[a-z0-9]*([0-9][a-z]|[a-z][0-9])[a-z0-9]*", "split"),
    ("percent", r"[0-9.]+%", "keep"),
    ("alpha_digit_dot", r"[a-z0-9\.-]+", "split"),
    ("number_range", r"[0-9\.]+-[0-9\.]+", "split"),
]
# Parts of split words that are no tokens, and the months of long dates.
PREFIXES = "en ex extra hetero homo homeo hyper il im in ir inter intra intro macro micro mono non omni post pre pro sub sym syn tele trans tri un uni up".split()
MONTHS = "january february march april may june july august september october november december".split()
SPECIAL = "μ×ñ"

_EMPTY = "array<string>"
#: Every word of a class but ``word`` has one of these characters.
_CLASSED = r"[-0-9./@$§¶%]"


def _whole(word: Column, pattern: str) -> Column:
    return word.rlike(rf"^(?:{pattern})\z")


def token_class(word: Column) -> Column:
    """The name of the first class that fits the whole word, else ``other``."""
    # letters only fit no other class, and without one of these characters no class but that fits
    out = F.when(_whole(word, "[a-zA-Z]+"), "word").when(~word.rlike(_CLASSED), "other")
    for name, pattern, _ in CLASSES:
        out = out.when(_whole(word, pattern), name)
    return out.otherwise("other")


def _group(word: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(word, pattern, k)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """MM/DD/YYYY from numbers, null where there is no such day."""
    return F.date_format(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")), "MM/dd/yyyy")


def short_date(word: Column) -> Column:
    """MM/DD/YYYY from mm/dd/yyyy, mm/dd/yy (69 to 99: 19yy) or mon-dd-yyyy; null where it isn't a day."""
    slash, abbreviation = r"^(\d{2})/(\d{2})/(\d{4}|\d{2})\z", r"^([a-z]{3})-(\d{1,2})-(\d{4})\z"
    number = lambda p, k: F.when(word.rlike(p), _group(word, p, k).cast("int"))
    year = number(slash, 3)
    year = F.when(F.length(_group(word, slash, 3)) == 4, year).when(year >= 69, year + 1900).otherwise(year + 2000)
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), _group(F.lower(word), abbreviation, 1)).cast("int")
    low = F.lower(word)
    return F.when(word.rlike(slash), calendar_date(year, number(slash, 1), number(slash, 2))).when(low.rlike(abbreviation), calendar_date(F.when(low.rlike(abbreviation), _group(low, abbreviation, 3).cast("int")), month, F.when(low.rlike(abbreviation), _group(low, abbreviation, 2).cast("int"))))


def split_tokens(word: Column) -> Column:
    """The word without hyphens, dots and commas, then its parts of three characters or more that aren't common prefixes."""
    useful = lambda x: (F.length(x) >= 3) & ~x.isin(*PREFIXES)
    parts = F.when(F.contains(word, F.lit("-")), F.split(word, "-")).otherwise(F.regexp_extract_all(word, F.lit("[a-z]{3,}"), F.lit(0)))
    return F.concat(F.array(F.translate(word, "-.,", "")), F.filter(parts, useful))


def ip_tokens(word: Column) -> Column:
    """A valid address is one token; else its octets as numbers and its digits together."""
    octets = F.transform(F.split(word, r"\."), lambda o: o.cast("int"))
    return F.when(F.forall(octets, lambda o: o <= 255), F.array(word)).otherwise(F.concat(F.transform(octets, lambda o: o.cast("string")), F.array(F.translate(word, ".", ""))))


def email_tokens(word: Column) -> Column:
    """One token for each @, with the other ones as dots."""
    parts = F.split(word, "@")
    variant = lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "."), F.lit("@"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    return F.when(F.size(parts) <= 2, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), variant))


def other_tokens(word: Column) -> Column:
    """Words of no class: whole if they have a special letter, else their amounts, runs of letters and a leading unit."""
    all_ = lambda p: F.regexp_extract_all(word, F.lit(p), F.lit(0))
    unit = F.regexp_extract(word, r"^([a-z]{1,3}/){1,2}[0-9]{0,3}[a-z]{0,3}", 0)
    return F.when(word.rlike(f"[{SPECIAL}]"), F.array(word)).otherwise(F.concat(all_(r"\$[0-9\.]+"), all_("[a-z]{3,}"), F.filter(F.array(unit), lambda x: x != "")))


def class_tokens(word: Column) -> Column:
    """The tokens of a stripped, lower-cased word. Empty tokens are dropped. Words of letters only, which no class but ``word`` fits, are
    told first; the class of another word is worked out once."""
    date = short_date(word)
    actions = {
        "keep": F.array(word), "strip": F.array(F.translate(word, ",.", "")), "split": split_tokens(word), "none": F.array().cast(_EMPTY),
        "date": F.when(date.isNotNull(), F.array(date)).otherwise(F.array().cast(_EMPTY)), "ip": ip_tokens(word), "email": email_tokens(word),
        "paragraph": F.array(F.substring(word, 1, 1), F.substring(word, 2, 2**31 - 1)),
    }

    def act(kind: Column) -> Column:
        out = F.when(kind == "other", other_tokens(word))
        for action in actions:
            if action != "keep":
                out = out.when(kind.isin(*[n for n, _, a in CLASSES if a == action]), actions[action])
        return out.otherwise(actions["keep"])

    return F.when(word.rlike(r"^[a-zA-Z]+\z"), F.array(word)).otherwise(F.filter(let(token_class(word), act), lambda x: x != ""))


def phone_tokens(word: Column, following: Column) -> Column:
    """Area code and number of a telephone number in one word or two; null if it isn't one."""
    area, own = _group(word, r"^\(([0-9]{3})[/\)]", 1), r"([0-9]{3})-([0-9]{4})"
    inside, after = word.rlike(own), F.coalesce(following.rlike(f"^{own}"), F.lit(False))
    a, b = _group(word, own, 1), _group(word, own, 2)
    joined = lambda x: F.concat(area, _group(x, own, 1), _group(x, own, 2))
    return F.when(area == "", None).when(inside, F.array(area, a, b, joined(word))).when(after, F.array(area, joined(following)))


def long_date(word: Column, second: Column, third: Column) -> Column:
    """MM/DD/YYYY from a month's full name and the two words after it; null if they aren't a day and a year."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
    day, year = (F.regexp_replace(x, r"^[,.]+|[,.]+$", "") for x in (second, third))
    ok = (month > 0) & day.rlike(r"^\d{1,2}\z") & year.rlike(r"^\d{4}\z")
    return F.when(ok, calendar_date(F.when(ok, year.cast("int")), month, F.when(ok, day.cast("int"))))


def token_groups(text: Column, lines: bool = True) -> Column:
    """One array of tokens for each word of a text that gives any, in order; a word's tokens share a position. lines: whether line breaks
    separate words."""
    words = F.transform(split_words(text, lines), lambda x: F.lower(x))
    return F.filter(let(words, words_to_groups), lambda g: F.size(g) > 0)


def words_to_groups(words: Column) -> Column:
    n = F.size(words)
    return F.transform(words, lambda x, i: _word_tokens(x, F.get(words, i + 1), F.get(words, i + 2), n - 1 - i))


def _word_tokens(x: Column, following: Column, third: Column, after: Column) -> Column:
    """The tokens of a lower-cased word; the next two words and how many come after it tell telephone numbers and dates."""
    phone = F.when(x.startswith("(") & (after > 0), phone_tokens(x, following))
    date = F.when(x.isin(MONTHS) & (after > 2), long_date(x, following, third))
    other = let(date, lambda d: F.when(d.isNotNull(), F.array(d)).otherwise(let(phone, lambda p: F.coalesce(p, let(strip_word(x), class_tokens)))))
    return F.when(x.rlike(r"^[a-z]+\z") & ~x.isin(MONTHS), F.array(x)).otherwise(other)


#: A word of letters, with brackets, commas, bullets and full stops around it perhaps, but no month as it stands: its letters are its one token.
_AROUND = f"[{STRIPPED}.]*+"
_PLAIN = rf"(?!(?:{'|'.join(MONTHS)})(?![^ ])){_AROUND}([a-z]++){_AROUND}(?![^ ])"


def token_bag(text: Column) -> Column:
    """The tokens of token_groups in one array, in another order: those of plain words, found by one pattern, then those of all other words, which
    alone are looked at one by one, each with the three words after it."""
    low = lowered(text)
    plain = F.regexp_extract_all(low, F.lit(rf"(?<![^ ]){_PLAIN}"), F.lit(1))
    rest = F.regexp_extract_all(low, F.lit(rf"(?<![^ ])(?!{_PLAIN})(?=([^ ]++(?: ++[^ ]++){{0,3}}+))[^ ]++"), F.lit(2))
    return F.concat(plain, F.flatten(F.transform(rest, first_tokens)))


def first_tokens(words: Column) -> Column:
    """The tokens of the first of some lower-cased words with spaces between them; the next three tell telephone numbers and dates. A word alone can be
    neither."""
    several = let(F.split(words, " +"), lambda w: _word_tokens(F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.get(w, F.lit(2)), F.size(w) - 1))
    return F.when(F.contains(words, F.lit(" ")), several).otherwise(let(strip_word(words), class_tokens))
