"""The rules of the two page classifiers.

A rule of the weighted classifier: type, weight, patterns of the URL, patterns of the title, signals of the
elements (attribute, part, weight), keywords.  A rule of the additive one: type, patterns, keywords, form hints.
"""

# Rules of the weighted classifier in order; ties go to the first.
WEIGHTED = (
    ("banking", 1.0,
     ("bank", "account", "transfer", "neft", "rtgs", "imps", "ifsc", "balance", "statement", "netbank", "ibanking"),
     ("bank", "account", "netbanking", "online.?banking"),
     (("form", "", 0.9), ("name", "account", 0.7), ("name", "ifsc", 0.95), ("name", "amount", 0.6)),
     ("account balance", "fund transfer", "beneficiary", "transaction", "net banking", "debit", "credit")),
    ("login", 1.0,
     ("login", "signin", "sign-?in", "auth", "authenticate", "logon", "sso", "oauth"),
     ("sign.?in", "log.?in", "login", "authenticate", "welcome.?back"),
     (("input", "password", 0.85), ("form", "", 0.9), ("form", "", 0.9), ("name", "password", 0.85)),
     ("sign in", "log in", "login", "password", "remember me", "forgot password", "forgot your password", "credentials")),
    ("registration", 1.0,
     ("register", "signup", "sign-?up", "create.?account", "new.?user", "join"),
     ("register", "sign.?up", "create.?account", "new.?account", "join"),
     (("form", "", 0.9), ("form", "", 0.9), ("name", "confirm", 0.5), ("name", "password_confirm", 0.8)),
     ("create account", "sign up", "register", "confirm password", "terms and conditions", "agree", "new here")),
    ("payment", 1.0,
     ("checkout", "payment", "cart", "order", "billing", "pay", "razorpay", "stripe", "payu"),
     ("checkout", "payment", "cart", "billing", "order"),
     (("name", "card", 0.85), ("name", "cvv", 0.95), ("name", "expiry", 0.8), ("name", "upi", 0.7)),
     ("checkout", "payment", "credit card", "debit card", "cvv", "billing address", "pay now", "place order")),
    ("healthcare", 1.0,
     ("health", "medical", "patient", "hospital", "clinic", "diagnostic", "pharmacy", "prescription", "doctor", "telemedicine"),
     ("health", "medical", "patient", "hospital", "clinic", "doctor", "appointment"),
     (("name", "patient", 0.9), ("name", "diagnosis", 0.85), ("name", "prescription", 0.8)),
     ("patient", "medical record", "prescription", "diagnosis", "health", "clinic", "hospital", "symptoms")),
    ("government", 1.0,
     ("gov", "passport", "aadhaar", "pan.?card", "voter.?id", "ration", "income.?tax", "gst", "digilocker", "umang", "parivahan", "epfo"),
     ("passport", "aadhaar", "pan.?card", "voter", "government", r"gov\.in", "tax"),
     (("name", "aadhaar", 0.95), ("name", "pan", 0.85), ("name", "passport", 0.9)),
     ("aadhaar", "pan card", "passport", "voter id", "government", "income tax", "gst", "identity")),
    ("ecommerce", 0.8,
     ("shop", "store", "product", "buy", "catalog", "wishlist", "amazon", "flipkart", "myntra"),
     ("shop", "store", "product", "buy", "deal", "offer"),
     (("class", "product", 0.6), ("class", "cart", 0.7), ("class", "price", 0.5)),
     ("add to cart", "buy now", "price", "product", "shop", "store", "delivery", "offer")),
    ("social_media", 0.7,
     ("facebook", "twitter", "instagram", "linkedin", "youtube", "tiktok", "reddit", "quora", "social", "feed", "timeline"),
     ("feed", "timeline", "social", "community", "posts"),
     (("class", "post", 0.6), ("class", "comment", 0.5), ("class", "story", 0.4)),
     ("post", "share", "like", "comment", "follow", "friend", "timeline", "feed")),
    ("email", 0.8,
     ("mail", "inbox", "compose", "outlook", "gmail", "yahoo.?mail", "proton", "email"),
     ("inbox", "mail", "compose", "email", "message"),
     (("name", "to", 0.5), ("name", "subject", 0.4), ("class", "compose", 0.6)),
     ("inbox", "compose", "email", "message", "reply", "forward", "sent", "drafts")),
    ("admin_dashboard", 0.7,
     ("admin", "dashboard", "panel", "console", "manage", "backend", "cms"),
     ("admin", "dashboard", "panel", "management", "console"),
     (("class", "sidebar", 0.4), ("class", "admin", 0.7), ("class", "dashboard", 0.6)),
     ("dashboard", "admin", "settings", "management", "analytics", "reports", "users", "configuration")),
    ("saas_dashboard", 0.5,
     ("app", "workspace", "project", "team", "settings", "billing", "plan", "subscription"),
     ("dashboard", "workspace", "project", "settings"),
     (("class", "sidebar", 0.3), ("class", "workspace", 0.5)),
     ("workspace", "project", "team", "billing", "subscription", "plan", "usage")),
    ("job_portal", 0.6,
     ("job", "career", "resume", "hiring", "apply", "linkedin.?jobs", "indeed", "naukri"),
     ("job", "career", "hiring", "apply", "vacancy"),
     (("name", "resume", 0.6), ("name", "experience", 0.4), ("name", "salary", 0.5)),
     ("job", "career", "apply", "resume", "experience", "salary", "hiring", "vacancy")),
    ("profile", 0.5,
     ("profile", "account", "{L}me{R}", "{L}user{R}", "{L}member{R}"),
     ("profile", "my.?account", "my.?info"),
     (("class", "avatar", 0.3), ("name", "bio", 0.4)),
     ("profile", "my account", "personal information", "edit profile", "about me", "settings")),
    ("settings", 0.5,
     ("settings", "preferences", "config", "options"),
     ("settings", "preferences", "configuration"),
     (("class", "settings", 0.5), ("input", "toggle", 0.3)),
     ("settings", "preferences", "configuration", "options", "privacy", "notifications", "account settings")),
)

# Rules of the additive classifier in order; ties go to the first.
ADDITIVE = (
    ("banking", ("bank", r"account/?(?:overview|balance|summary)", "wire", "transfer", "loan", "invest"),
     ("account balance", "transfer funds", "wire transfer", "routing number", "iban"), ("routing", "account number", "iban", "swift", "bic")),
    ("login", ("login", "signin", "sign-in", "auth", "sso", "oauth"), ("sign in", "log in", "forgot password", "remember me"), ("username", "password", "email address")),
    ("registration", ("register", "signup", "sign-up", "create.?account"), ("create account", "sign up", "confirm password", "agree to terms"), ("confirm password", "agree", "terms")),
    ("payment", ("pay", "billing", "invoice", "checkout", "stripe", "paypal"), ("credit card", "debit card", "billing address", "payment", "charge"), ("card number", "cvv", "expiry", "billing address")),
    ("ecommerce", ("shop", "store", "cart", "checkout", "product", "buy"), ("add to cart", "checkout", "shipping address", "billing"), ("card number", "cvv", "expiry", "billing", "shipping")),
    ("healthcare", ("health", "medical", "patient", "clinic", "hospital", "diagnos"), ("patient", "diagnosis", "prescription", "medical record", "appointment"), ("medical history", "allergies", "medication", "insurance id")),
    ("government", (r"gov\.", r"\.gov", "tax", "irs", "passport", "aadhaar"), ("social security", "tax return", "citizen", "government id"), ("ssn", "taxpayer id", "license number", "passport")),
    ("admin_dashboard", ("admin", "dashboard", "panel", "console", "manage"), ("dashboard", "analytics", "settings", "users", "admin"), ("api key", "secret", "token", "webhook")),
    ("email", ("mail", "inbox", "email", "compose", "outlook", "gmail"), ("inbox", "compose", "sent", "draft", "subject"), ("to", "subject", "message body")),
    ("social_media", ("feed", "timeline", "profile", "friend", "post", "message"), ("friends", "followers", "posts", "share", "like", "comment"), ("bio", "about me", "website link")),
    ("saas_dashboard", ("workspace", "project", "team"), ("workspace", "project", "api", "usage", "plan", "billing"), ("api key", "project name", "webhook url")),
)
