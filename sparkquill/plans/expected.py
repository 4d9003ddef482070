"""The values that the SQL forms compare with, stated here once more and not taken from the code, so that a wrong value there is a difference."""

from __future__ import annotations

# Characters that are deleted inside words, those that are stripped from words, and entities in the order of their replacement.
DELETED = " !\"&'*+:;<=>?[]^_`{|}~"
STRIPPED = "(),•"
ENTITIES = [("&amp;", "&"), ("&para;", "¶"), ("&sect;", "§"), ("&hyph;", "-"), ("&times;", "×"), ("&blank;", " "), ("&mu;", "μ"), ("&ntilde", "ñ"), ("&bull;", "•")]

# Classes of words in the order in which they are tried, with pattern and what becomes of the word.
CLASSES = [
    ("alpha_digit", "[a-zA-Z]+-[0-9]+", "split"),
    ("date1", "[0-9]{2}/[0-9]{2}/[0-9]{4}", "date"),
    ("date2", "[0-9]+-[0-9]+-[0-9]-", "none"),
    ("date3", "[a-zA-Z]{3}-[0-9]+-[0-9]+", "date"),
    ("date4", "[0-9]{2}/[0-9]{2}/[0-9]{2}", "date"),
    ("digit_alpha", "[0-9]+-[a-zA-Z]+", "split"),
    ("dot_notes", r"[a-zA-Z]+\.[a-zA-Z.]+", "strip"),
    ("ip", r"([0-9]{1,3}\.){3}[0-9]{1,3}", "ip"),
    ("dots", r"[0-9,]*\.[0-9]+", "keep"),
    ("email", "([a-zA-Z.]+@)+[a-z.]+", "email"),
    ("hyphen", "[a-zA-Z]*(-[a-zA-Z]*){1,3}", "split"),
    ("integer", "[0-9]{1,3}(,[0-9]{3})*", "strip"),
    ("monetory", r"\$[0-9.,]+", "strip"),
    ("url3", r".+\.(com|org|cn|us|edu).+", "keep"),
    ("file", r".+\.(pdf|html|sh|txt|doc|zip|exe|rar|avi|xls|dll|gif|jpg|pic|png|bat)", "split"),
    ("word", "[a-zA-Z]+", "keep"),
    ("digits", "[0-9]+", "keep"),
    ("paragraph", "(§|¶)+[a-z0-9.-]+", "paragraph"),
    ("url", "https?://.+", "keep"),
    ("url2", r"www\..+", "keep"),
    ("digit_alpha_mixes", "[0-9a-zA-Z]+-[0-9a-zA-Z-]+", "split"),
    ("no_hyphen_mixes", "[a-z0-9]*([0-9][a-z]|[a-z][0-9])[a-z0-9]*", "split"),
    ("percent", "[0-9.]+%", "keep"),
    ("alpha_digit_dot", "[a-z0-9.-]+", "split"),
    ("number_range", "[0-9.]+-[0-9.]+", "split"),
]
# Parts of split words that are no tokens, and the months of long dates.
PREFIXES = ["en", "ex", "extra", "hetero", "homo", "homeo", "hyper", "il", "im", "in", "ir", "inter", "intra", "intro", "macro", "micro", "mono", "non", "omni", "post", "pre", "pro", "sub", "sym", "syn", "tele", "trans", "tri", "un", "uni", "up"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# The published endings of the stemmer's second to fourth step, and words with stems of their own.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
