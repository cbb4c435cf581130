"""Regular expressions in one notation for two dialects.

``{L}`` and ``{R}`` are an ASCII word boundary before and after a word character, ``{B}`` one on either side; ``{s}`` is
the white space of the web's regular expressions and ``{S}`` its complement.  ``java`` and ``re2`` spell them out:
Java's own ``\\b`` isn't ASCII, and neither dialect's ``\\s`` knows the Unicode spaces.
"""

from __future__ import annotations

_SPACES = r"\t\n\x0B\x0C\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as text.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_JAVA = {"{L}": "(?<![A-Za-z0-9_])", "{R}": "(?![A-Za-z0-9_])", "{B}": "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"}
_RE2 = dict.fromkeys(("{L}", "{R}", "{B}"), r"\b")


def _spell(pattern: str, boundaries: dict[str, str], space: str, other: str) -> str:
    for k, v in boundaries.items():
        pattern = pattern.replace(k, v)
    # inside a class the spaces stand alone, outside they are one
    return pattern.replace("[{s}", "[" + _SPACES).replace("[^{s}", "[^" + _SPACES).replace("{s}]", _SPACES + "]").replace("{s}", space).replace("{S}", other)


def java(pattern: str) -> str:
    """In Java's dialect; printable ASCII is told apart first, as Java tests a class range by range."""
    return _spell(pattern, _JAVA, f"[[^!-~]&&[{_SPACES}]]", f"[!-~[^{_SPACES}]]")


def re2(pattern: str) -> str:
    return _spell(pattern, _RE2, f"[{_SPACES}]", f"[^{_SPACES}]")


# Patterns whose matches are entities, in the order in which they are tried.
EMAIL = r"{B}[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}{R}"
PHONE = (
    r"\+?\d{1,3}[{s}.-]?\(?\d{2,4}\)?[{s}.-]?\d{3,4}[{s}.-]?\d{3,4}",
    r"\(\d{3}\){s}?\d{3}[{s}.-]\d{4}",
    r"\d{3}[{s}.-]\d{3}[{s}.-]\d{4}",
    r"\d{5}{s}\d{6}",
    r"\d{10,12}",
)
CARD = (
    r"{L}\d{4}[{s}-]?\d{4}[{s}-]?\d{4}[{s}-]?\d{4}{R}",
    r"{L}\d{4}[{s}-]?\d{6}[{s}-]?\d{4}{R}",
    r"{L}\d{4}[{s}-]?\d{5}[{s}-]?\d{5}{R}",
)
#: Cards of fifteen digits, in strict mode only.
CARD_15 = r"{L}\d{4}[{s}-]?\d{6}[{s}-]?\d{5}{R}"
KEY_ASSIGNED = r"""(?i)(?:api[_\-]?key|apikey|secret[_\-]?key|access[_\-]?key){s}*[:=]{s}*['"]?([A-Za-z0-9_\-]{20,})['"]?"""
KEY_PREFIXED = r"(?:sk|pk|ak|rk|ghp|gho|AIza)[A-Za-z0-9_\-]{16,}"
KEY_RT = (
    r"{L}(?:sk|pk|ak|rk|ghp|gho|ghu|ghs|github_pat|xox[baprs])[_\-]?[A-Za-z0-9\-]{16,}{B}",
    r"{L}AIza[A-Za-z0-9_\-]{35}{B}",
    KEY_ASSIGNED,
)
JWT = r"{L}eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}{B}"
BEARER = r"(?i)Bearer{s}+[A-Za-z0-9_\-.]{20,}"
SESSION = r"(?i){L}(?:sess|sid|token|jwt)[_-]?[A-Za-z0-9_\-]{20,}{B}"
GOV = (
    r"{L}\d{3}-?\d{2}-?\d{4}{R}",
    r"{L}[A-Z]{5}\d{4}[A-Z]{R}",
    r"{L}\d{4}{s}?\d{4}{s}?\d{4}{R}",
    r"{L}\d{12}{R}",
    r"{L}[A-Z]{1,2}\d{6,7}[A-Z\d]{R}",
)
GOV_RT = (GOV[0], GOV[2], "(?i)" + GOV[1], GOV[3], "(?i)" + GOV[4])
MEDICAL = (r"(?i){L}MRN[{s}.-]?\d{6,10}{R}", r"{L}[A-Z]{3}\d{7,9}{R}")
BANK = (
    r"(?i){L}(?:account|acct)[{s}.#:_-]*(?:number|#|no\.?)?[{s}:#_]*(\d{8,17}){R}",
    r"(?i){L}(?:routing|rtn|aba)[{s}.#:_-]*(?:number|#|no\.?)?[{s}:#_]*(\d{9}){R}",
    r"{L}\d{9}{R}",
)
STREET = r"(?i)\d+{s}+[A-Za-z0-9{s}]+(?:st|nd|rd|th|ave|blvd|dr|ln|way|ct|pl|cir|hwy|terr|trail|pkwy){R}"
#: The same with the street's kind as a whole word, in strict mode only.
STREET_WORD = r"(?i)\d+{s}+[A-Za-z0-9{s}]*{L}(?:st|nd|rd|th|ave|blvd|dr|ln|way|ct|pl|cir|hwy|terr|trail|pkwy){R}"
ZIP = r"{L}\d{5}(?:-\d{4})?{R}"
PO_BOX = r"(?i){L}(?:P\.?O\.?{s}*Box|Post{s}*Office{s}*Box){s}+\d+"
CURRENCY = (r"^[$€£¥]{s}?\d{1,3}(?:[,.]\d{3})*(?:\.\d{2})?$", r"(?i)^\d{1,3}(?:[,.]\d{3})*(?:\.\d{2})?{s}?(?:USD|EUR|GBP|INR|JPY|CAD|AUD)$")
DATE = (
    r"{L}(?:0[1-9]|1[0-2])[/\-.](?:0[1-9]|[12]\d|3[01])[/\-.](?:19|20)\d{2}{R}",
    r"{L}(?:0[1-9]|[12]\d|3[01])[/\-.](?:0[1-9]|1[0-2])[/\-.](?:19|20)\d{2}{R}",
    r"{L}(?:19|20)\d{2}[/\-.](?:0[1-9]|1[0-2])[/\-.](?:0[1-9]|[12]\d|3[01]){R}",
    r"(?i){L}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{s}+\d{1,2},?{s}+(?:19|20)\d{2}{R}",
    r"(?i){L}\d{1,2}{s}+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{s}+(?:19|20)\d{2}{R}",
)
YEAR = r"{L}((?:19|20)\d{2}){R}"
USERNAME = r"^[A-Za-z0-9_\-.]+$"

# Confidence of a key, a government id and a medical id by form, first match wins.
KEY_GRADES = (
    (r"{L}sk[_-](?:live[_-]|test[_-]|prod[_-])?[A-Za-z0-9]{16,64}{R}", 0.95),
    (r"{L}pk[_-](?:live[_-]|test[_-]|prod[_-])?[A-Za-z0-9]{16,64}{R}", 0.95),
    (r"{L}(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}{R}", 0.98),
    (r"{L}xox[baprs]-[A-Za-z0-9-]{10,48}{B}", 0.97),
    (r"{L}AIza[A-Za-z0-9_-]{35}{B}", 0.96),
)
KEY_LONG = (r"^[A-Za-z0-9_\-]{32,}$", 0.4)
GOV_GRADES = (
    (r"^\d{3}-?\d{2}-?\d{4}$", 0.92),
    (r"^\d{12}$", 0.88),
    (r"(?i)^[A-Z]{5}\d{4}[A-Z]$", 0.9),
    (r"(?i)^[A-Z]\d{7,8}$", 0.85),
    (r"(?i)^[A-Z]{1,2}\d{6,7}[A-Z\d]$", 0.82),
)
MEDICAL_GRADES = ((r"(?i)^MRN[{s}.-]?\d{6,10}$", 0.88), (r"(?i)^[A-Z]{3}\d{7,9}$", 0.75), (r"^\d{6,10}$", 0.6))

# What the outbound checks look for, with their labels; and what is replaced before text leaves.
FIREWALL = {
    "lib": (
        (r"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}{R}", "EMAIL"),
        (CARD[0], "CREDIT_CARD"),
        (r"{L}\d{3}-?\d{2}-?\d{4}{R}", "SSN"),
        (r"{L}[A-Za-z0-9]{32,}{R}", "POSSIBLE_API_KEY"),
        (r"(?i)Bearer{s}+[A-Za-z0-9_\-.]+", "AUTH_TOKEN"),
        (r"(?i){L}(?:password|passwd|pwd){s}*[:=]{s}*{S}+", "PASSWORD"),
    ),
    "rt": (
        (r"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}{R}", "EMAIL"),
        (CARD[0], "CREDIT_CARD"),
        (r"{L}\d{3}-?\d{2}-?\d{4}{R}", "SSN"),
        (r"{L}(?:sk|pk|ak|ghp|gho|github_pat|xox[baprs])[_\-]?[A-Za-z0-9\-]{16,}{B}", "API_KEY"),
        (r"(?i)Bearer{s}+[A-Za-z0-9_\-.]+", "AUTH_TOKEN"),
        (r"(?i){L}(?:password|passwd|pwd){s}*[:=]{s}*{S}+", "PASSWORD"),
        (JWT, "JWT"),
        (r"{L}\d{12}{R}", "POSSIBLE_GOV_ID"),
    ),
}
CLOUD = (
    (r"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}{R}", "EMAIL"),
    (CARD[0], "CREDIT_CARD"),
    (r"{L}\d{3}-?\d{2}-?\d{4}{R}", "GOVERNMENT_ID"),
    (r"(?i)Bearer{s}+[A-Za-z0-9_\-.]+", "AUTH_TOKEN"),
    (r"(?i){L}(?:password|passwd|pwd|secret|api[_-]?key){s}*[:=]{s}*[^{s},}]+", "SECRET"),
)
# Words in a text that stand for the fields a page would have, by hint.
TEXT_HINTS = {
    "password": r"(?i)password|passwd|secret|login|sign.?in|credential",
    "financial": r"(?i)credit|card|account|routing|payment|bank|checkout|billing",
    "medical": r"(?i)medical|health|patient|diagnosis|mrn|prescription|hospital|clinic",
    "government": r"(?i)ssn|social.?security|aadhaar|pan.?card|passport|government|national.?id",
    "email": r"(?i)email|e-?mail|inbox|compose",
    "phone": r"(?i)phone|mobile|tel|call|contact",
    "birth": r"(?i)birth|dob|date.?of.?birth",
}
USER_TEXT = r"(?i)username|user.?name|login|handle"
# Words of a form field's name, placeholder and label, with category and confidence; first match wins.
FIELD_RULES = (
    (r"{L}email{R}|{L}mail{R}", "email", "EMAIL", 0.95),
    (r"{L}phone{R}|{L}mobile{R}|{L}telephone{R}", "tel", "PHONE", 0.95),
    (r"{L}credit.?card{R}|{L}card.?number{R}|{L}cc-?\d|{L}visa{R}|{L}mastercard{R}", None, "CREDIT_CARD", 0.95),
    (r"{L}cvv{R}|{L}cvc{R}|{L}security.?code{R}", None, "CREDIT_CARD", 0.93),
    (r"{L}expir|{L}exp{R}", None, "CREDIT_CARD", 0.88),
    (r"{L}ssn{R}|{L}social.?security{R}|{L}tax.?id{R}|{L}taxpayer{R}", None, "GOVERNMENT_ID", 0.95),
    (r"{L}passport{R}|{L}driver.?licen[sc]e{R}|{L}license.?num{R}|{L}id.?num{R}", None, "GOVERNMENT_ID", 0.92),
    (r"{L}(?:first.?name|last.?name|full.?name|your.?name|name.?on){R}|{L}surname{R}", None, "NAME", 0.88),
    (r"{L}address{R}|{L}street{R}|{L}zip.?code{R}|{L}postal{R}|{L}city{R}|{L}state{R}|{L}country{R}", None, "ADDRESS", 0.88),
    (r"{L}dob{R}|{L}birth.?date{R}|{L}birthday{R}|{L}date.?of.?birth{R}", None, "DATE_OF_BIRTH", 0.90),
    (r"{L}medical{R}|{L}diagnosis{R}|{L}prescription{R}|{L}health{R}|{L}insurance.?id{R}", None, "MEDICAL_ID", 0.88),
    (r"{L}api.?key{R}|{L}secret{R}|{L}token{R}|{L}access.?key{R}", None, "API_KEY", 0.85),
    (r"{L}account.?num{R}|{L}routing{R}|{L}iban{R}|{L}swift{R}|{L}bank{R}", None, "BANK_ACCOUNT", 0.90),
)
#: Text that may not be typed or chosen by a planned action.
ACTION_SENSITIVE = r"(?i)(?:password|passwd|token|secret|api[_-]?key|credit|card|ssn|social security|account number)"
SEARCH_REQUEST = r"(?i)^{s}*(?:search|find){s}+(?:for{s}+)?(.+){s}*$"
