"""Names, levels, weights and word lists that results depend on."""

# Categories of entities, in order.
CATEGORIES = (
    "EMAIL", "PHONE", "NAME", "ADDRESS", "PASSWORD", "USERNAME", "CREDIT_CARD", "BANK_ACCOUNT", "API_KEY", "AUTH_TOKEN",
    "DATE_OF_BIRTH", "GOVERNMENT_ID", "MEDICAL_ID", "FINANCIAL_DATA", "PRIVATE_DOCUMENT_CONTENT",
)

# Risk levels from the lowest; the index is the order.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Scores from which a level holds.
LEVEL_FROM = {"CRITICAL": 0.8, "HIGH": 0.6, "MEDIUM": 0.35}

# Base risk by category.
BASE_RISK = {
    "PASSWORD": "CRITICAL", "API_KEY": "CRITICAL", "AUTH_TOKEN": "CRITICAL", "CREDIT_CARD": "CRITICAL",
    "EMAIL": "HIGH", "PHONE": "HIGH", "BANK_ACCOUNT": "HIGH", "GOVERNMENT_ID": "HIGH", "MEDICAL_ID": "HIGH", "FINANCIAL_DATA": "HIGH",
    "USERNAME": "MEDIUM", "NAME": "MEDIUM", "ADDRESS": "MEDIUM", "DATE_OF_BIRTH": "MEDIUM", "PRIVATE_DOCUMENT_CONTENT": "MEDIUM",
}
# Sensitivity by base risk.
SENSITIVITY_OF = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5}
SENSITIVITY = {c: SENSITIVITY_OF[r] for c, r in BASE_RISK.items()}
DEFAULT_SENSITIVITY = 0.5

# Sensitivity of page types.
PAGE_SENSITIVITY = {
    "banking": 0.95, "healthcare": 0.9, "payment": 0.9, "login": 0.85, "ecommerce": 0.8, "admin_dashboard": 0.75, "saas_dashboard": 0.75,
    "social_media": 0.6, "profile": 0.6, "registration": 0.55, "settings": 0.5, "email": 0.5, "job_portal": 0.45, "government": 0.9, "unknown": 0.3,
}
DEFAULT_PAGE = 0.3

# Weights of the five parts of a risk score.
WEIGHTS = {"entity_sensitivity": 0.30, "model_confidence": 0.25, "dom_context": 0.20, "page_context": 0.15, "semantic_context": 0.10}
DEFAULT_DOM = 0.4

# Terms that raise and lower the semantic part; the runtime mode has the first 15 of HIGH_TERMS only.
HIGH_TERMS = (
    "password", "secret", "private", "confidential", "sensitive", "credential", "pin", "ssn", "social security", "aadhaar",
    "pan", "passport", "bank account", "credit card", "debit card", "otp", "one time password", "mfa", "two factor",
)
RT_HIGH_TERMS = HIGH_TERMS[:15]
LOW_TERMS = ("public", "share", "publicly visible", "published", "open", "community", "forum", "guest", "visitor", "anyone can see", "public profile")

# What an element's label says about its content, first match wins.
ELEMENT_TIERS = (
    (("password", "passwd", "pass-?word"), 1.0),
    (("email", "e-?mail", "electronic.?mail"), 0.9),
    (("login", "sign-?in", "log-?on", "authenticate"), 0.85),
    (("table", "grid", "record", "row"), 0.7),
)
# The same for parts of its autocomplete attribute.
ELEMENT_AUTOCOMPLETE = (("password", 1.0), ("email", 0.9), ("tel", 0.85), ("cc-", 1.0))

# Mail domains and senders.
TRUSTED_DOMAINS = ("google.com", "microsoft.com", "apple.com", "github.com", "mozilla.org", "w3.org", "schema.org", "cloudflare.com", "amazonaws.com", "gstatic.com", "googleapis.com")
EXCLUDED_DOMAINS = {
    "lib": ("example.com", "test.com", "localhost", "domain.com", "email.com", "mail.com", "sentry.io", "wixpress.com"),
    "rt": ("example.com", "test.com", "localhost", "domain.com", "email.com", "mail.com", "sentry.io", "wixpress.com", "example.org", "example.net", "test.org", "invalid", "localhost.localdomain"),
}
ROLE_SENDERS = {
    "lib": ("test", "admin", "info", "noreply", "no-reply", "support", "hello"),
    "rt": ("test", "admin", "info", "noreply", "no-reply", "support", "hello", "webmaster", "postmaster", "abuse", "hostmaster"),
}

# Words of form fields that hint at what a page asks for.
FIELD_HINTS = {
    "password": ("password", "passwd", "secret"),
    "financial": ("credit", "card", "account", "routing", "payment", "bank"),
    "medical": ("medical", "health", "patient", "diagnosis", "mrn"),
    "government": ("ssn", "social security", "aadhaar", "pan", "passport", "national id"),
}
# Words of a field's name, placeholder, label or autocomplete.
BIRTH_WORDS = ("birth", "dob", "date of birth")
USER_WORDS = ("username", "user name", "login", "handle")

# Labels of the learned classifier, and the one whose category has another name.
MODEL_LABELS = (
    "EMAIL", "PHONE", "CREDIT_CARD", "NAME", "ADDRESS", "PASSWORD", "USERNAME", "API_KEY", "AUTH_TOKEN", "SSN", "MEDICAL_ID",
    "BANK_ACCOUNT", "FINANCIAL_DATA", "DATE_OF_BIRTH", "NONE",
)
LABEL_CATEGORY = {"SSN": "GOVERNMENT_ID"}
# Categories that the runtime's booster may add, its least score, and its limits.
BOOST_TYPES = ("NAME", "USERNAME", "PASSWORD", "ADDRESS")
BOOST_FROM = 0.55
BOOST_CHUNKS, BOOST_LENGTH = 40, 180
VISION_REGIONS, VISION_SIDE, VISION_FROM = 12, 10, 0.6

# Categories of form fields by autocomplete attribute.
AUTOCOMPLETE = {
    "email": "EMAIL", "name": "NAME", "given-name": "NAME", "family-name": "NAME", "additional-name": "NAME", "honorific-prefix": "NAME", "honorific-suffix": "NAME",
    "tel": "PHONE", "tel-national": "PHONE", "tel-country-code": "PHONE",
    "street-address": "ADDRESS", "address-line1": "ADDRESS", "address-line2": "ADDRESS", "address-line3": "ADDRESS", "address-level1": "ADDRESS", "address-level2": "ADDRESS",
    "address-level3": "ADDRESS", "address-level4": "ADDRESS", "postal-code": "ADDRESS", "country": "ADDRESS", "country-name": "ADDRESS",
    "cc-name": "CREDIT_CARD", "cc-number": "CREDIT_CARD", "cc-exp": "CREDIT_CARD", "cc-exp-month": "CREDIT_CARD", "cc-exp-year": "CREDIT_CARD", "cc-csc": "CREDIT_CARD", "cc-type": "CREDIT_CARD",
    "bday": "DATE_OF_BIRTH", "bday-day": "DATE_OF_BIRTH", "bday-month": "DATE_OF_BIRTH", "bday-year": "DATE_OF_BIRTH",
    "sex": "GOVERNMENT_ID", "organization": "NAME", "organization-title": "NAME", "new-password": "PASSWORD", "current-password": "PASSWORD", "username": "USERNAME",
}
# Beginnings of autocomplete attributes that are sensitive without being in the table.
AUTOCOMPLETE_PREFIXES = ("cc-", "email", "name", "tel", "address-line", "address-city", "address-state", "address-zip", "address-country", "postal-code", "organization", "username", "new-password", "current-password")

# Placeholders of redacted text by style ("category": from the table; the others are made from the category's name).
PLACEHOLDER = {
    "EMAIL": "[EMAIL_REDACTED]", "PHONE": "[PHONE_REDACTED]", "NAME": "[NAME_REDACTED]", "ADDRESS": "[ADDRESS_REDACTED]", "PASSWORD": "[PASSWORD_REDACTED]",
    "USERNAME": "[USERNAME_REDACTED]", "CREDIT_CARD": "[CC_REDACTED]", "BANK_ACCOUNT": "[ACCOUNT_REDACTED]", "API_KEY": "[API_KEY_REDACTED]", "AUTH_TOKEN": "[TOKEN_REDACTED]",
    "DATE_OF_BIRTH": "[DOB_REDACTED]", "GOVERNMENT_ID": "[GOVID_REDACTED]", "MEDICAL_ID": "[MEDID_REDACTED]", "FINANCIAL_DATA": "[FIN_REDACTED]", "PRIVATE_DOCUMENT_CONTENT": "[DOC_REDACTED]",
}
# Display tokens.
DISPLAY_TOKEN = {
    "EMAIL": "EMAIL_TOKEN", "PHONE": "PHONE_TOKEN", "PASSWORD": "SECRET_TOKEN", "USERNAME": "USERNAME_TOKEN", "NAME": "NAME_TOKEN", "ADDRESS": "ADDRESS_TOKEN",
    "CREDIT_CARD": "CARD_TOKEN", "BANK_ACCOUNT": "ACCT_TOKEN", "API_KEY": "API_TOKEN", "AUTH_TOKEN": "AUTH_TOKEN", "DATE_OF_BIRTH": "DOB_TOKEN",
    "GOVERNMENT_ID": "GOV_ID_TOKEN", "MEDICAL_ID": "MED_TOKEN", "FINANCIAL_DATA": "FIN_TOKEN", "PRIVATE_DOCUMENT_CONTENT": "DOC_TOKEN",
}
DEFAULT_TOKEN = "PII_TOKEN"
# Labels of numbered tokens that differ from the category.
TOKEN_LABEL = {"DATE_OF_BIRTH": "DOB", "GOVERNMENT_ID": "GOVID", "MEDICAL_ID": "MEDID", "FINANCIAL_DATA": "FIN", "PRIVATE_DOCUMENT_CONTENT": "DOC"}

# Parts of log keys whose values are hidden.
LOG_HINTS = ("pass", "secret", "token", "api", "key", "ssn", "credit", "card", "cvv", "pin")
# Actions and keys that a plan may use.
ACTIONS = ("search", "click", "type", "scroll", "submit", "select", "keypress", "back", "forward", "reload")
ACTION_KEYS = ("Enter", "Escape", "Tab", "ArrowUp", "ArrowDown", "ArrowLeft", "ArrowRight")

# Limits of the stores.
SHOT_BYTES, SHOTS_KEPT, URL_CHARS, TITLE_CHARS, AUDIT_KEPT = 6 * 1024 * 1024, 10, 512, 256, 200
CLOUD_CHARS, CLOUD_MARK = 9000, "\n[CONTEXT_TRUNCATED]"
EXPORT_FOLDER = "protected-screenshots"
