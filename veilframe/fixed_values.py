"""Fixed values of the governance rules: categories, patterns, policies, roles.

Everything in this file is data that results depend on. Logic lives elsewhere.
"""

# --- fixed values: PII categories -------------------------------------------
CATEGORIES = (
    "account_number",
    "private_address",
    "private_email",
    "private_person",
    "private_phone",
    "private_url",
    "private_date",
    "secret",
)

ACTIONS = ("allow", "redact", "hash", "vault", "review", "block")
DIRECTIONS = ("inbound", "outbound")
STATUSES = ("success", "blocked", "review_queued", "error", "rbac_denied", "timeout")
RULE_CONFIDENCE = 0.95
MODEL_VERSION = "openai/privacy-filter"
BIOES_PREFIXES = ("B", "I", "O", "E", "S")

# --- fixed values: honorifics and first names that start a person span -------
HONORIFICS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")
FIRST_NAMES = (
    "John", "Jane", "Alice", "Bob", "Sarah", "Michael", "Emma", "David", "William", "James", "Mary",
    "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Karen", "Nancy",
    "Lisa", "Betty", "Margaret", "Sandra", "Ashley", "Kimberly", "Emily", "Donna", "Michelle",
    "Dorothy", "Carol", "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca", "Sharon", "Laura",
    "Cynthia", "Kathleen", "Amy", "Shirley", "Angela", "Helen", "Anna", "Brenda", "Pamela",
    "Nicole", "Samantha", "Katherine", "Christine", "Debra", "Rachel", "Catherine", "Carolyn",
    "Janet", "Ruth", "Maria", "Heather", "Diane", "Virginia", "Julie", "Joyce", "Victoria",
    "Olivia", "Kelly", "Christina", "Lauren", "Joan", "Evelyn", "Judith", "Megan", "Cheryl",
    "Andrea", "Hannah", "Martha", "Jacqueline", "Frances", "Gloria", "Ann", "Teresa", "Kathryn",
    "Sara", "Janice", "Jean", "Madison", "Doris", "Abigail", "Julia", "Judy", "Grace", "Denise",
    "Amber", "Marilyn", "Beverly", "Danielle", "Theresa", "Sophia", "Marie", "Diana", "Brittany",
    "Natalie", "Isabella", "Charlotte", "Rose", "Alexis", "Kayla",
)
STREET_TYPES = ("St", "Ave", "Blvd", "Dr", "Ln", "Rd", "Way", "Ct", "Pl", "Circle", "Pkwy")

# --- fixed values: the eight detectors, in tie-break order -------------------
# Written for java.util.regex. Digits, whitespace and word edges are the Unicode
# ones: _D any decimal digit, _S any whitespace, (?<!_W) / (?!_W) a word edge.
# A leading lookahead on the first character only skips hopeless positions; the
# e-mail one starts at the head of a run (or after a match), so that a long run
# without "@" is read once instead of once per character.
_D = r"\p{Nd}"
_S = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NOT_S = _S.replace("[", "[^", 1)
_W = r"[\p{L}\p{N}_]"
_SEP = _S[:-1] + ".-]"
_DASH = _S[:-1] + "-]"
_LOCAL = "[a-zA-Z0-9._%+-]"
_EDGE = rf"(?<!{_W})"
_END = rf"(?!{_W})"

WHITESPACE = _S
DIGIT = _D

PATTERNS = (
    ("private_email", rf"(?={_LOCAL})(?:(?<!{_LOCAL})|\G){_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"),
    ("private_phone", rf"(?=[+(\p{{Nd}}])(?:\+?1{_SEP}?)?\(?{_D}{{3}}\)?{_SEP}?{_D}{{3}}{_SEP}?{_D}{{4}}"),
    ("account_number", rf"(?={_D}){_EDGE}{_D}{{4}}{_DASH}?{_D}{{4}}{_DASH}?{_D}{{4}}(?:{_DASH}?{_D}{{4}})?{_END}"),
    ("secret", rf"(?={_D}){_EDGE}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_END}"),
    ("private_url", rf"https?://{_NOT_S}+"),
    ("private_date", rf"(?={_D}){_EDGE}(?:{_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}|{_D}{{4}}[/-]{_D}{{1,2}}[/-]{_D}{{1,2}}){_END}"),
    ("private_address", rf"(?={_D}){_EDGE}{_D}{{1,5}}{_S}+(?iu:(?:[A-Z][a-z]+{_S}+){{1,3}}(?:{'|'.join(STREET_TYPES)}))(?:\.(?={_W})|{_END})"),
    ("private_person", rf"(?=[A-Z]){_EDGE}(?:{'|'.join(h.replace('.', '[.]') for h in HONORIFICS)}|{'|'.join(FIRST_NAMES)}){_S}+[A-Z][a-z]+{_END}"),
)

# --- fixed values: bundled policies ------------------------------------------
# policy -> (version, rows of direction, category, action, reason)
POLICIES = {
    "strict_financial": (
        "strict_financial_v1",
        (
            ("inbound", "account_number", "redact", "Redact account numbers in inbound queries"),
            ("inbound", "private_address", "allow", "Addresses allowed in inbound queries for lookups"),
            ("inbound", "private_email", "allow", "Emails allowed in inbound queries for lookups"),
            ("inbound", "private_person", "allow", "Names allowed in inbound queries for lookups"),
            ("inbound", "private_phone", "allow", "Phones allowed in inbound queries for lookups"),
            ("inbound", "private_url", "allow", "URLs allowed in inbound queries"),
            ("inbound", "private_date", "allow", "Dates allowed in inbound queries"),
            ("inbound", "secret", "block", "Secrets must never appear in inbound queries"),
            ("outbound", "account_number", "redact", "Redact account numbers in results"),
            ("outbound", "private_address", "redact", "Redact addresses in results"),
            ("outbound", "private_email", "redact", "Redact emails in results"),
            ("outbound", "private_person", "redact", "Redact person names in results"),
            ("outbound", "private_phone", "redact", "Redact phone numbers in results"),
            ("outbound", "private_url", "redact", "Redact URLs in results"),
            ("outbound", "private_date", "review", "Dates flagged for review in results"),
            ("outbound", "secret", "block", "Secrets must never appear in results"),
        ),
    ),
    "permissive_analyst": (
        "permissive_analyst_v1",
        (
            ("inbound", "account_number", "hash", "Hash account numbers for identity consistency"),
            ("inbound", "private_address", "allow", "Addresses allowed for analyst lookups"),
            ("inbound", "private_email", "allow", "Emails allowed for analyst lookups"),
            ("inbound", "private_person", "allow", "Names allowed for analyst lookups"),
            ("inbound", "private_phone", "allow", "Phones allowed for analyst lookups"),
            ("inbound", "private_url", "allow", "URLs allowed for analyst queries"),
            ("inbound", "private_date", "allow", "Dates allowed for analyst queries"),
            ("inbound", "secret", "block", "Secrets must never appear in queries"),
            ("outbound", "account_number", "redact", "Redact full account numbers in results"),
            ("outbound", "private_address", "review", "Addresses flagged for review"),
            ("outbound", "private_email", "allow", "Emails visible to analysts"),
            ("outbound", "private_person", "hash", "Hash names for identity consistency"),
            ("outbound", "private_phone", "allow", "Phones visible to analysts"),
            ("outbound", "private_url", "allow", "URLs visible to analysts"),
            ("outbound", "private_date", "allow", "Dates visible to analysts"),
            ("outbound", "secret", "vault", "Secrets vaulted in results"),
        ),
    ),
}
PHONE_SUPPRESSED = "Numeric value in JSON context — suppressed phone false positive"

# --- fixed values: roles ------------------------------------------------------
ROLE_TOOLS = {
    "intern": (),
    "analyst": ("customer_api", "sql_query"),
    "compliance_officer": ("customer_api", "sql_query"),
}
_TABLES = ("accounts", "advisors", "customers", "transactions")
ROLE_TABLES = {"intern": (), "analyst": _TABLES, "compliance_officer": _TABLES}
# no entry for a role or table: every column is allowed
ROLE_COLUMNS = {
    "analyst": {
        "customers": ("id", "first_name", "last_name", "email", "phone", "address", "date_of_birth"),
        "accounts": ("id", "customer_id", "account_type", "balance", "opened_date"),
        "transactions": ("id", "account_id", "amount", "description", "timestamp", "counterparty"),
        "advisors": ("id", "name", "email", "phone", "region"),
    },
}
RESTRICTED_COLUMNS = {"customers": ("ssn",), "accounts": ("account_number",)}
ROLE_API_RESTRICTED = {"analyst": ("account_number", "ssn")}
ROLE_POLICY = {"intern": "", "analyst": "permissive_analyst", "compliance_officer": "strict_financial"}
API_TOOLS = ("customer_api", "customer_api_lookup", "customer_api_search")
UNPARSEABLE = "__UNPARSEABLE__"

# --- fixed values: texts and labels of the request log ------------------------
TRUNCATED = "\n... [truncated]"
MAX_OUTPUT_CHARS = 4096
PII_THRESHOLD = 0.7
LAYERS = (
    "RBAC Gate",
    "Inbound PII",
    "Inbound Policy",
    "Execution",
    "Outbound PII",
    "Outbound Policy",
    "Audit Log",
)
AUDIT_ACTION = {
    "allow": "allow",
    "transform": "redact",
    "deny": "block",
    "block": "block",
    "human_review": "review",
    "audit_and_allow": "allow",
}
ACCOUNT_TYPES = ("checking", "savings", "investment", "trust", "retirement")
# texts of generated rows: own wording, all kinds of personal data among the second group
REGIONS = tuple(f"{side} {part}" for side in ("Upper", "Lower") for part in ("Valley", "Harbor", "Plains", "Lakes", "Hills"))
NEUTRAL_DESCRIPTIONS = (
    "salary for the past month", "weekly food order", "power and water, third quarter", "cash from a machine",
    "refund of a returned item", "train ticket", "yearly club fee", "car repair", "share of heating costs",
    "lunch at the corner cafe", "spare parts", "dentist, own share", "garden tools", "toll for two axles", "school trip",
)
PII_DESCRIPTIONS = (
    "loan paid back to Sarah Brandt in full", "gift for Mr. Okoro on leaving", "fee of Dr. Lindqvist for a second opinion",
    "paid into 4410-2275-9031 as agreed", "rent for 18 Willow Grove Lane", "deposit returned, call 555-204-7716 with questions",
    "invoice sent to books@willowgrove.example", "share of costs, Mrs. Tanaka", "moved from 3021-5568-7740 to savings",
    "bike sold to David Moreau", "course fee dated 06/21/2023", "repairs at 9 Station Road by agreement",
    "tickets, receipt to m.kline@post.example dated 11/02/2022", "support line 555-318-4402, case closed",
    "helper's wage, Maria Keller",
)
