"""Word lists, patterns, texts, limits and formats.

Everything here has to be equal in every conforming scanner, because finding ids, gate results and
report texts depend on it. The values are stated plainly and in their natural order. ``{tool}`` marks
the place of the product name, which is a parameter of this library.
"""

TOOL_NAME = "Plumbline"
CHECK_NAME = "plumbline"

# ---- paths -----------------------------------------------------------------------------------
IGNORED_NAMES = [
    "node_modules", ".next", ".git", "dist", "build", "out", "coverage", ".turbo", ".vercel",
    ".cache", ".claude",
]
CODE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
SQL_EXTENSION = ".sql"

# ---- enums -----------------------------------------------------------------------------------
SEVERITIES = ["HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
CATEGORIES = ["ACCESS", "SECRETS", "CONFIG", "INJECTION"]
CATEGORY_LABEL = {
    "ACCESS": "ASVS: Authorization & Access Control",
    "SECRETS": "ASVS: Configuration & Secret Management",
    "CONFIG": "ASVS: Security Configuration",
    "INJECTION": "ASVS: Validation, Sanitization & Encoding",
}
AREA_LABEL = {
    "ACCESS": "Access Control & Authorization",
    "SECRETS": "Secrets & Key Management",
    "CONFIG": "Security Configuration",
    "INJECTION": "Injection & Input Validation",
}
LEVEL_RANK = {"vulnerable": 0, "safer": 1, "safe": 2}
LEVEL_LABEL = {"vulnerable": "Vulnerable", "safer": "Safer available", "safe": "Safe"}
LEVEL_CHIP = {"vulnerable": "high", "safer": "medium", "safe": "low"}
ACTIVE_STATUSES = ["active", "trialing"]
DUNNING_STATUSES = ["past_due", "unpaid", "incomplete"]
BILLING_EVENT_TYPES = [
    "checkout.session.completed",
    "customer.subscription.created", "customer.subscription.updated",
    "customer.subscription.deleted", "customer.subscription.trial_will_end",
    "invoice.paid", "invoice.payment_failed",
]
PULL_REQUEST_ACTIONS = ["opened", "synchronize", "reopened"]

# ---- limits ----------------------------------------------------------------------------------
MAX_FILE_BYTES = 1_000_000
MAX_PROJECT_FILES = 10_000
MAX_ARCHIVE_BYTES = 256 * 1024 * 1024
MAX_SUBMISSION_BYTES = 512 * 1024
MAX_SUBMISSION_FINDINGS = 100
RATE_WINDOW_SECONDS = 60
RATE_LIMIT = 6
MAX_ATTEMPTS = 5
BACKOFF_BASE_SECONDS = 30
BACKOFF_MAX_EXPONENT = 6
LEASE_SECONDS = 600
ANNOTATION_BATCH = 50
ANNOTATION_TITLE_CHARS = 255
ANNOTATION_MESSAGE_CHARS = 4000
REPORT_TEXT_CHARS = 60_000
JOB_ERROR_CHARS = 2000
GATE_RECHECK_SECONDS = 300
RECENT_SCANS = 20

# ---- formats ---------------------------------------------------------------------------------
FINDING_ID_PREFIX = "pf_"
FINDING_ID_HEX = 12
TOKEN_PREFIX = "pflt_"
TOKEN_DISPLAY_CHARS = 13
BEARER_PATTERN = r"^Bearer\s+(\S+)\z"
REPO_PATTERN = r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\z"
NAME_PATTERN = r"^[A-Za-z0-9._-]+\z"
SHA_PATTERN = r"(?i)^[0-9a-f]{7,40}\z"
ZERO_SHA_PATTERN = r"^0+\z"

# ---- regular expressions (Java syntax) -------------------------------------------------------
# WS is the white space of the rule language: ASCII plus NBSP, BOM and the Unicode space separators.
# B and E are the word boundaries before and after an ASCII word character.
WS = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NOT_WS = r"\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
B = r"(?<![A-Za-z0-9_])"
E = r"(?![A-Za-z0-9_])"

PUBLIC_VARIABLE = r"process\.env\.(NEXT_PUBLIC_[A-Z0-9_]+)"
PUBLIC_BY_DESIGN = r"(?i)ANON|PUBLISHABLE"
TIER_ONE_NAME = r"(?i)SERVICE_ROLE|SECRET|PASSWORD|PRIVATE"
TIER_TWO_NAME = r"(?i)(_KEY|_TOKEN)\z"
USE_CLIENT = rf"(?m)^{WS}*['\"]use client['\"]"
USE_SERVER = rf"(?m)^{WS}*['\"]use server['\"]"
SERVICE_ROLE = r"SERVICE_ROLE|service_role"
DATABASE_URL = rf"postgres(?:ql)?://([^{_NOT_WS}'\"`:/@]+):([^{_NOT_WS}'\"`@]+)@([^{_NOT_WS}'\"`:/?]+)"
LOCAL_HOST = r"(?i)^(localhost|127\.0\.0\.1|::1|0\.0\.0\.0)\z"
PLACEHOLDER_PASSWORD = r"(?i)^(placeholder|changeme|your[-_]?password|example|sample|dummy|x{3,})\z"
BRACKETED_PASSWORD = r"^[\[<{][^\n\r\u2028\u2029]*[\]>}]\z"
CREATE_TABLE = (
    rf"(?i)create{WS}+table{WS}+(?:if{WS}+not{WS}+exists{WS}+)?[\"`']?(?:\w+\.)?(\w+)[\"`']?"
)
ENABLE_ROW_SECURITY = (
    rf"(?i)alter{WS}+table{WS}+(?:if{WS}+exists{WS}+)?[\"`']?(?:\w+\.)?(\w+)[\"`']?"
    rf"{WS}+enable{WS}+row{WS}+level{WS}+security"
)
PERMISSIVE_POLICY = rf"(?i)(?:using|with{WS}+check){WS}*\({WS}*true{WS}*\)"
AUTH_HINTS = [
    rf"\.auth\.getUser{WS}*\(", rf"\.auth\.getSession{WS}*\(", rf"getServerSession{WS}*\(",
    rf"{B}getSession{WS}*\(", rf"{B}getUser{WS}*\(", rf"{B}requireUser{WS}*\(",
    rf"{B}requireAuth{WS}*\(", rf"{B}currentUser{WS}*\(", rf"{B}getCurrentUser{WS}*\(",
    rf"{B}verify(?:Jwt|Token|Session){WS}*\(", r"withApiAuth", r"@clerk/",
]
DATA_HINTS = [
    rf"\.from{WS}*\({WS}*['\"`]", rf"{B}supabase{E}", rf"{B}prisma{WS}*\.", rf"{B}drizzle{E}",
    rf"{B}sql`", rf"{B}pool\.query{WS}*\(", rf"{B}db\.(?:select|insert|update|delete|query|execute){E}",
]
ROUTE_FILE_NAME = r"^route\.(t|j)sx?\z"
APP_DIRECTORY = r"(^|/)app/"
PAGES_API_DIRECTORY = r"(^|/)pages/api/"
MIDDLEWARE_NAMES = ["middleware.ts", "middleware.js"]
HEADER_CONFIG_FILE = r"(^|/)next\.config\.(js|ts|mjs|cjs)\z"
HEADERS_FUNCTION = rf"headers{WS}*\({WS}*\)|headers{WS}*:{WS}*async"
CONTENT_POLICY_HEADER = r"(?i)Content-Security-Policy"
TRANSPORT_HEADER = r"(?i)Strict-Transport-Security"
EXAMPLE_FILE = r"(?i)(^|[./])(example|sample|template|fixture|mock)s?([./]|\z)"
CREDENTIAL_FORMATS = [
    ("an AWS access key id", rf"{B}AKIA[0-9A-Z]{{16}}{E}"),
    ("a GitHub access token", rf"{B}gh[pousr]_[A-Za-z0-9]{{36,}}{E}"),
    ("a Stripe secret key", rf"{B}[sr]k_live_[0-9a-zA-Z]{{16,}}{E}"),
    ("a Slack token", rf"{B}xox[baprs]-[0-9A-Za-z-]{{10,}}{E}"),
]
PRIVATE_KEY_BLOCK = "-----BEGIN[A-Z ]*PRIVATE" + " KEY" + "-----"
CONCATENATED_SQL = (
    rf"\.(?:query|execute|unsafe|raw){WS}*\({WS}*(?:`[^`]*\$\{{|['\"][^'\"]*['\"]{WS}*\+)"
)
DYNAMIC_EXECUTION = rf"{B}eval{WS}*\(|{B}new{WS}+Function{WS}*\("
RAW_HTML = rf"dangerouslySetInnerHTML{WS}*={WS}*\{{\{{[^}}]*__html{WS}*:{WS}*([^}}]+)\}}\}}"
STATIC_TEXT = rf"^{WS}*['\"`]"
SANITIZED_TEXT = r"(?i)sanitiz|dompurify|purify|escapehtml"

# ---- rule texts ------------------------------------------------------------------------------
# rule -> (severity, category, confidence, title, detail, remediation); {arg} is the matched name.
RULE_TEXT = {
    "A1": (
        "HIGH", "SECRETS", "definitive",
        "Secret exposed via NEXT_PUBLIC_ env var (bundled to the browser)",
        "{arg} is prefixed NEXT_PUBLIC_, so its value is inlined into the client bundle and readable by anyone.",
        "Drop the NEXT_PUBLIC_ prefix and read this only in server code (route handlers, server actions, server components). Rotate the value.",
    ),
    "A1B": (
        "MEDIUM", "SECRETS", "definitive",
        "Possible secret exposed via NEXT_PUBLIC_ env var",
        "{arg} is bundled to the browser. Confirm it is meant to be public (e.g. a publishable key). If it is a secret, it is leaked.",
        "If secret: remove the NEXT_PUBLIC_ prefix and read it server-side only.",
    ),
    "A2": (
        "HIGH", "SECRETS", "definitive",
        "Supabase service_role key referenced in a client component",
        "This is a client component (\"use client\") referencing the service_role key, which bypasses RLS. If it reaches the bundle, it is full database access for any visitor.",
        "Use the service_role key only in server-only modules. In the browser, use the anon key with RLS enforced.",
    ),
    "A3": (
        "HIGH", "SECRETS", "definitive",
        "Hardcoded database connection string with credentials",
        "A Postgres connection string containing a username and password appears directly in source.",
        "Move it to a server-side environment variable and rotate the exposed credentials.",
    ),
    "B0": (
        "INFO", "ACCESS", "definitive",
        "No SQL migrations found — database authorization not verified here",
        "If you use Supabase, RLS is verifiable only when policies live in migrations; if managed in the dashboard, {tool} cannot see it. If you use Neon (plain Postgres), authorization is expected in the app layer instead.",
        "Keep RLS policies in versioned migrations so they are reviewable and verifiable.",
    ),
    "B1": (
        "HIGH", "ACCESS", "definitive",
        "Table \"{arg}\" has no RLS enabled in migrations",
        "No \"alter table {arg} enable row level security\" was found. Without RLS, any client holding the anon key can read/write this table. (If RLS is enabled in the dashboard, {tool} can't see it — migrations are the verifiable place.)",
        "Add: alter table {arg} enable row level security; then define explicit policies.",
    ),
    "B2": (
        "HIGH", "ACCESS", "definitive",
        "Permissive RLS policy (USING/WITH CHECK true)",
        "A policy evaluates to TRUE for everyone, which disables the access control it appears to provide.",
        "Scope the policy to the requesting user, e.g. using (auth.uid() = user_id).",
    ),
    "C": (
        "MEDIUM", "ACCESS", "heuristic",
        "{arg} performs data access with no detectable auth check",
        "This server entry point reads or writes data, but no authentication/authorization call was detected on its path.",
        "Enforce an auth check server-side before any data access. Client-side route guards do not count.",
    ),
    "D": (
        "LOW", "CONFIG", "definitive",
        "No security headers configured in next.config",
        "No headers() function or CSP/HSTS configuration was found.",
        "Add a headers() function setting at least Content-Security-Policy, Strict-Transport-Security, and X-Frame-Options.",
    ),
    "E1": (
        "HIGH", "SECRETS", "definitive",
        "Hardcoded credential committed to source",
        "A value matching the format of {arg} appears directly in source. Committed credentials are readable by anyone with repository access and persist in git history even after the line is removed.",
        "Move it to a server-side environment variable and rotate the exposed credential immediately.",
    ),
    "E2": (
        "HIGH", "SECRETS", "definitive",
        "Private key committed to source",
        "A PEM private-key block appears directly in source. Anyone with repository access holds the key, and it persists in git history even after the line is removed.",
        "Remove the key from the repository, store it in a secret manager, and rotate the key pair.",
    ),
    "F": (
        "MEDIUM", "INJECTION", "heuristic",
        "SQL query assembled by string concatenation or interpolation",
        "A database query argument is built from a template literal or a concatenated string. If any interpolated part is caller-controlled, this is a SQL injection vector. (Tagged-template clients that parameterize their inputs are not flagged.)",
        "Pass values as parameterized query placeholders instead of building the SQL string yourself.",
    ),
    "G": (
        "MEDIUM", "INJECTION", "heuristic",
        "Dynamic code execution",
        "Code is executed from a string at runtime. If any part of that string is caller-controlled, it is a remote code execution vector.",
        "Remove the dynamic evaluation; use a data structure, lookup table, or explicit parser instead of executing constructed code.",
    ),
    "H": (
        "MEDIUM", "INJECTION", "heuristic",
        "Raw HTML rendered from a non-constant value",
        "A non-constant value is rendered as raw HTML via dangerouslySetInnerHTML. If any part is caller-controlled and unsanitized, this is a cross-site scripting (XSS) vector.",
        "Sanitize the HTML with a vetted sanitizer before rendering, or render the value as text instead of raw HTML.",
    ),
}
MIDDLEWARE_CAVEAT = (
    " A middleware auth guard exists in the project — verify whether it actually covers this path."
)
ENTRY_POINT_KINDS = ["Route handler", "API route", "Server action"]
PROJECT_FILE = "(project)"

# ---- control references ----------------------------------------------------------------------
CONTROL_VERSION = "5.0"
DEFAULT_CHAPTER = "ASVS 5.0"
CATEGORY_REQUIREMENTS = {
    "ACCESS": ["v5.0.0-8.1.1", "v5.0.0-8.2.1"],
    "SECRETS": ["v5.0.0-14.1.1", "v5.0.0-14.1.2"],
    "CONFIG": ["v5.0.0-14.4.1", "v5.0.0-14.4.2", "v5.0.0-14.4.3"],
    "INJECTION": ["v5.0.0-1.2.1", "v5.0.0-1.3.1"],
}
# (id, chapter, section, title, text)
REQUIREMENTS = [
    ("v5.0.0-8.1.1", "V8 Authorization", "General Authorization Design",
     "Server-side enforcement of access control",
     "Verify that the application enforces access control rules on a trusted service layer and never relies solely on client-side checks. Every server entry point that accesses protected data must verify the requester's identity and authorization before completing the operation."),
    ("v5.0.0-8.2.1", "V8 Authorization", "Operation Level Access Control",
     "Authorization checks at every entry point",
     "Verify that authorization decisions are made at every function or endpoint that performs sensitive actions or returns sensitive data, including server actions, route handlers, and API routes. Missing authorization on a single entry point bypasses all other controls."),
    ("v5.0.0-14.1.1", "V14 Configuration", "Secret Management",
     "No hardcoded secrets or credentials in source",
     "Verify that the application does not contain hardcoded secrets, API keys, or database credentials in source code, configuration files, or comments. Secrets must be sourced from a secret store or environment variables that are scoped to the runtime that needs them."),
    ("v5.0.0-14.1.2", "V14 Configuration", "Secret Management",
     "Server-only secrets not exposed to the client",
     "Verify that secrets intended for server use only are not embedded in client bundles. In Next.js, environment variables prefixed NEXT_PUBLIC_ are inlined into the browser bundle; high-privilege keys (service-role, signing, admin) must never carry that prefix."),
    ("v5.0.0-14.4.1", "V14 Configuration", "HTTP Security Headers",
     "Content Security Policy",
     "Verify that the application sets a Content-Security-Policy header that restricts the origins from which scripts, styles, and other resources may be loaded, reducing the impact of cross-site scripting."),
    ("v5.0.0-14.4.2", "V14 Configuration", "HTTP Security Headers",
     "HTTP Strict Transport Security",
     "Verify that the application sets a Strict-Transport-Security header that instructs browsers to use TLS for all future connections, with an appropriate max-age and includeSubDomains."),
    ("v5.0.0-14.4.3", "V14 Configuration", "HTTP Security Headers",
     "Clickjacking and MIME-sniffing protections",
     "Verify that responses set X-Frame-Options (or a frame-ancestors CSP directive) to prevent clickjacking, and X-Content-Type-Options: nosniff to prevent MIME-type confusion attacks."),
    ("v5.0.0-1.2.1", "V1 Encoding and Sanitization", "Injection Prevention",
     "Safe, parameterized interaction with interpreters",
     "Verify that the application protects against injection by using parameterized queries, prepared statements, or safe object-relational mappers for database access, and never builds a query or other interpreter input by concatenating or interpolating caller-controllable data. Code must not be constructed and executed dynamically (e.g. eval) from runtime strings."),
    ("v5.0.0-1.3.1", "V1 Encoding and Sanitization", "Output Encoding",
     "Context-aware output encoding and sanitization",
     "Verify that untrusted data is contextually encoded or sanitized before it is rendered. In particular, values rendered as raw HTML (e.g. via dangerouslySetInnerHTML) must be sanitized with a vetted sanitizer, or rendered as text, to prevent cross-site scripting."),
]
UNKNOWN_REQUIREMENT = "unknown"
NO_REQUIREMENT_TEXT = "No requirement metadata available."

# ---- gate providers --------------------------------------------------------------------------
DEFAULT_PROVIDER = "vercel"
# (id, label, mechanism, settings link, instruction texts); {repo} {branch} {check} are filled per row
PROVIDERS = [
    ("vercel", "Vercel", "deployment-dispatch", "https://vercel.com/dashboard", [
        "Open your project in Vercel → Settings → Deployment Checks.",
        "Click \"Add Checks\" and select the \"{check}\" check — Vercel auto-discovers it from the workflow.",
        "Require it for Production and save.",
        "Note: requiring a check in Deployment Checks needs a paid Vercel plan.",
    ]),
    ("netlify", "Netlify", "branch-check", "https://github.com/{repo}/settings/branches", [
        "Open your repository on GitHub → Settings → Branches.",
        "Add or edit a branch protection rule for `{branch}`.",
        "Enable \"Require status checks to pass before merging\" and select the \"{check}\" check.",
        "Save. Netlify production deploys build from `{branch}`, so protecting it holds the deploy until the check passes.",
    ]),
    ("cloudflare", "Cloudflare Pages", "branch-check", "https://github.com/{repo}/settings/branches", [
        "Open your repository on GitHub → Settings → Branches.",
        "Add or edit a branch protection rule for `{branch}`.",
        "Enable \"Require status checks to pass before merging\" and select the \"{check}\" check.",
        "Save. Cloudflare Pages production deploys build from `{branch}`, so protecting it holds the deploy until the check passes.",
    ]),
]
NO_BRANCH_TEXT = "your production branch"

# ---- request texts ---------------------------------------------------------------------------
REQUEST_HEAD = (
    "Analyze the following deterministic findings from a Next.js + Supabase/Neon project scan.\n"
    "For each, produce an explanation grounded in the cited ASVS requirement and a concrete remediation.\n\n"
)
REQUEST_FOOT = (
    "\nCall submit_analysis with one entry per finding (matched by id) plus any additionalObservations."
)

# ---- report texts ----------------------------------------------------------------------------
GATE_PASSED = "Gate **passed** — no findings at or above `{fail_on}`."
GATE_FAILED = "Gate **failed** — findings at or above `{fail_on}`. Production promotion is held."
GATE_REPORT_ONLY = (
    "Findings at or above `{fail_on}` present. Gate is in **report-only** mode, so the deploy is not blocked."
)
CI_GATE_FAILED = "Gate **failed** — findings at or above `{fail_on}`. Production promotion should be held."
NO_FINDINGS = "No findings."
NEUTRAL_TITLE = "{tool} could not complete this scan"
NEUTRAL_SUMMARY = (
    "{tool} did not finish scanning this commit, so it is **not** gating the deploy.\n\n_Reason: {reason}_"
)
NEUTRAL_TEXT = (
    "No findings were produced because the scan did not complete. This check is neutral and does not block."
)
NOTE_SUBSCRIPTION = (
    "\n\n_Explanations are unavailable without an active subscription. The gate still runs on the findings._"
)
NOTE_UNAVAILABLE = "\n\n_Explanations are temporarily unavailable. The gate still runs on the findings._"
NOTE_REQUEST_FAILED = "\n\n_Backend enrichment unavailable ({reason}). Gate evaluated on local findings._"
CONSOLE_NOTHING = "No issues found by the current checks. (First-pass posture check, not full ASVS certification.)"

# ---- workflow files --------------------------------------------------------------------------
# {tool} {check} {action} {secret} {branch} are filled in; everything else is literal.
WORKFLOW_DISPATCH = """name: {tool}
on:
  repository_dispatch:
    types: [vercel.deployment.success]
jobs:
  security-gate:
    runs-on: ubuntu-latest
    permissions:
      actions: read
      contents: read
      statuses: write
      checks: write
    steps:
      - uses: vercel/repository-dispatch/actions/status@v1
        with:
          name: {check}
      - uses: actions/checkout@v4
      - uses: {action}
        with:
          api-key: ${{ secrets.{secret} }}
          commit-sha: ${{ github.event.client_payload.git.sha }}
"""
WORKFLOW_BRANCH = """name: {tool}
on:
  pull_request:
  push:
    branches: [{branch}]
jobs:
  security-gate:
    runs-on: ubuntu-latest
    permissions:
      contents: read
      checks: write
    steps:
      - uses: actions/checkout@v4
      - uses: {action}
        with:
          api-key: ${{ secrets.{secret} }}
          commit-sha: ${{ github.event.pull_request.head.sha || github.sha }}
"""
