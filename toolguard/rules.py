"""Fixed values.

Every list, table, pattern and text below is a *fixed value*: results are only
right when it equals the published rule set exactly, so it is stated plainly
and in its natural order.  Patterns are written in Python ``re`` syntax;
``toolguard.functions.regex`` turns them into Java patterns for Spark.
No logic lives in this module.
"""

# ---------------------------------------------------------------- capabilities
CATEGORIES = ("file_access", "network_access", "subprocess_execution", "environment_access")

PYTHON_BEHAVIOR = {
    "file_access": [r"\bopen\s*\(", r"\bos\.remove\(", r"\bos\.rename\(", r"\bshutil\."],
    "network_access": [r"\brequests\.", r"\burllib\.", r"\bsocket\.", r"\baiohttp\."],
    "subprocess_execution": [r"\bsubprocess\.", r"\bos\.system\(", r"\bos\.popen\("],
    "environment_access": [r"\bos\.environ"],
}

JS_BEHAVIOR = {
    "file_access": [
        r"\brequire\(\s*[\"']fs[\"']", r"\bfrom\s+[\"']fs[\"']", r"\bfs\.",
        r"\breadFile", r"\bwriteFile", r"\bunlink",
    ],
    "network_access": [
        r"\bfetch\s*\(", r"\baxios\.", r"\bhttp\.request", r"\bhttps\.request",
        r"\bXMLHttpRequest", r"\brequire\(\s*[\"'](?:http|https|node-fetch)[\"']",
    ],
    "subprocess_execution": [
        r"\bchild_process", r"\bexec\s*\(", r"\bexecSync\s*\(", r"\bspawn\s*\(", r"\bspawnSync\s*\(",
    ],
    "environment_access": [r"\bprocess\.env"],
}

# Words whose presence in a description means a behavior is mentioned (report).
MENTION_WORDS = {
    "file_access": ["file", "disk", "read", "write", "save", "load"],
    "network_access": ["url", "http", "web", "internet", "fetch", "download", "api", "request"],
    "subprocess_execution": ["run", "execute", "command", "process", "shell"],
    "environment_access": ["environment", "config", "variable", "setting"],
}

# Words that declare a capability (permission analysis); a larger list on purpose.
DECLARE_WORDS = {
    "file_access": ["file", "disk", "read", "write", "save", "load", "open", "store", "document", "path"],
    "network_access": ["url", "http", "web", "internet", "fetch", "download", "api", "request", "connect", "network"],
    "subprocess_execution": ["run", "execute", "command", "process", "shell", "invoke", "script"],
    "environment_access": ["environment", "config", "variable", "setting", "env", "credentials"],
}

MISMATCH_SEVERITY = {
    "environment_access": "HIGH",
    "subprocess_execution": "HIGH",
    "network_access": "MEDIUM",
    "file_access": "LOW",
}

UNDISCLOSED_SEVERITY = {
    "file_access": "MEDIUM",
    "network_access": "MEDIUM",
    "subprocess_execution": "HIGH",
    "environment_access": "HIGH",
}

CAPABILITY_TEXT = {
    "file_access": "Read/write/delete files on disk or in-memory file objects",
    "network_access": "Make outbound network connections (HTTP, socket, DNS)",
    "subprocess_execution": "Run shell commands or spawn child processes",
    "environment_access": "Read or write OS environment variables (often secret storage)",
}

# ------------------------------------------------------------------- file lists
JS_EXTENSIONS = (".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx")
PYTHON_PRUNED_DIRS = (
    ".git", "node_modules", "dist", "build", "vendor", "third_party", ".pytest_cache", ".venv", "venv",
)
PYTHON_BEHAVIOR_PRUNED_DIRS = PYTHON_PRUNED_DIRS + (".next", "coverage")
JS_PRUNED_DIRS = (
    "node_modules", "dist", "build", ".next", "coverage", ".git", ".venv", "venv", ".pytest_cache",
)
PYTHON_TEST_DIRS = ("test", "tests", "testing")
JS_SKIPPED_DIRS = ("node_modules", "dist", "build", "test", "tests", "__tests__", ".next", "coverage")
JS_SKIPPED_SUFFIXES = (".test.js", ".test.ts", ".spec.js", ".spec.ts", ".d.ts")

# --------------------------------------------------------------- inherent risk
RISK_WORDS = {
    "CRITICAL": [
        "delete", "drop", "wipe", "destroy", "purge", "format",
        "transfer_money", "transfer_funds", "send_payment", "pay", "withdraw",
        "shutdown", "terminate", "kill_process", "sudo", "root_access",
        "exec",
    ],
    "HIGH": [
        "send_email", "send_message", "post_public", "publish", "broadcast",
        "grant_access", "revoke", "admin", "override", "bypass", "escalate",
        "execute_command", "run_shell", "eval_code", "exec_code",
        "subprocess", "environment variable",
        "database", "databases", "credentials", "personal", "read_file",
    ],
    "MEDIUM": [
        "update", "modify", "write", "create", "upload", "edit", "change_password",
        "reset_password", "install", "uninstall", "deploy",
    ],
}

RISK_TEXT = {
    "CRITICAL": "This tool's name/description suggests it can cause irreversible or high-impact harm (data loss, financial transactions, system shutdown).",
    "HIGH": "This tool's name/description suggests it can affect other people or systems (sending messages, granting access, running commands).",
    "MEDIUM": "This tool's name/description suggests it modifies data or state, but in a typically reversible way.",
    "LOW": "This tool appears to be primarily read-only or informational based on its name/description.",
}

# ---------------------------------------------------------- description checks
# (pattern on the lowercased description, confidence, explanation), in order.
INSTRUCTION_PHRASES = [
    (r"ignore (?:all )?(?:previous|prior|above) instructions", "HIGH", "Direct instruction to override system prompts"),
    (r"disregard (?:all )?(?:previous|prior|above) instructions", "HIGH", "Direct instruction to override system prompts"),
    (r"you must (?:always|never)", "HIGH", "Imperative command directed at the AI agent"),
    (r"do not (?:tell|inform|mention|notify) the user", "HIGH", "Explicit instruction to conceal from the user"),
    (r"without (?:telling|informing|notifying) the user", "HIGH", "Implicit instruction to act secretly"),
    (r"always call \w+", "HIGH", "Instructs AI to call another tool regardless of context"),
    (r"after (?:calling|using) this tool,?\s*(?:also|always)", "HIGH", "Forces chaining to another tool"),
    (r"in addition to your (?:task|instructions)", "HIGH", "Adds hidden task beyond what user requested"),
    (r"append .* to (?:every|all) (?:response|reply|message)", "HIGH", "Instructs AI to modify its outputs"),
    (r"forward (?:this|the) (?:data|result|output|information) to", "HIGH", "Instructs data forwarding to external recipient"),
    (r"send (?:this|the) (?:data|result|output|information) to", "HIGH", "Instructs data sending to external recipient"),
    (r"\byou are (?:now|a)\b", "MEDIUM", "Attempts to change the AI's role or identity"),
    (r"before (?:responding|answering|replying) to the user", "MEDIUM", "Instructs pre-response behavior modification"),
    (r"secretly", "MEDIUM", "Suggests hidden/covert action"),
    (r"system\s*:", "LOW", "Contains system-prompt-like formatting"),
]

LEGITIMATE_FRAMING = [
    r"this (?:is a|is an) .* (?:assistant|helper|agent|system)",
    r"the following (?:is|are) .* (?:instruction|guideline|rule|policy)",
    r"please (?:note|remember|keep in mind|be aware)",
]

ZERO_WIDTH = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
HIDDEN_TEXT = (
    "Description contains invisible/zero-width Unicode characters, "
    "which can hide extra text from a human reviewer while an AI "
    "agent still reads it in full."
)
LONG_DESCRIPTION = 800
LONG_TEXT = (
    "Description is {n} characters long - far longer than a typical tool description, "
    "which can be used to smuggle in extra instructions."
)

# (pattern, ignoring case, confidence, explanation), in order; severity is HIGH.
REDIRECT_PHRASES = [
    (r"instead of (?:using |calling )?[\"']?(\w+)[\"']?", "HIGH", "Explicit redirect away from another tool"),
    (r"(?:use|call) this (?:tool )?instead of [\"']?(\w+)[\"']?", "HIGH", "Direct instruction to use this tool in place of another"),
    (r"overrides? (?:the )?[\"']?(\w+)[\"']? tool", "HIGH", "Claims to override another tool"),
    (r"replaces? (?:the )?[\"']?(\w+)[\"']? tool", "HIGH", "Claims to replace another tool"),
    (r"takes? priority over [\"']?(\w+)[\"']?", "MEDIUM", "Claims higher priority than another tool"),
    (r"supersedes [\"']?(\w+)[\"']?", "MEDIUM", "Claims to supersede another tool"),
]
REDIRECT_TEXT = (
    "{explanation} - description instructs the AI agent to use this tool instead of "
    "'{referenced}', a known technique for hijacking calls meant for a different, trusted tool."
)
DUPLICATE_TEXT = (
    "'{name}' is registered {n} times across different files ({files}). Whichever registration "
    "a client loads determines which code actually runs when this tool is called."
)
UNDISCLOSED_TEXT = (
    "The tool performs {what} but its description never mentions this. An AI agent trusting "
    "the description would not expect these side effects."
)
INFLATED_TEXT = (
    "The description implies {what} but the tool's code does not actually use this. This may be "
    "an honest copy-paste error, but it misleads the AI agent."
)

# ------------------------------------------------------------------ blast radius
CAPABILITY_POINTS = {
    "file_access": 6, "network_access": 8, "subprocess_execution": 10, "environment_access": 10,
}
# category -> (sensitivity, description, targets)
DOWNSTREAM = {
    "file_access": (3, "Files on disk (read, write, delete)",
                    ["local_filesystem", "config_files", "source_code", "data_files", "credentials_stored_in_files"]),
    "network_access": (4, "Outbound network connections",
                       ["external_apis", "internal_services", "dns", "attacker_server", "cloud_services"]),
    "subprocess_execution": (5, "Shell commands and child processes",
                             ["shell", "system_commands", "other_processes", "installed_tools", "os_level"]),
    "environment_access": (5, "Environment variables (common secret storage)",
                           ["api_keys", "database_passwords", "cloud_credentials", "secrets_manager", "jwt_tokens"]),
}
# (name, required categories, targets, description), in order; +5 points each.
CHAINS = [
    ("Data exfiltration chain", ["file_access", "network_access"],
     ["remote_attacker_server", "data_leak"],
     "Reads local files and sends them over the network"),
    ("Credential harvesting chain", ["environment_access", "network_access"],
     ["remote_attacker_server", "stolen_credentials"],
     "Reads env vars (secrets) and exfiltrates them via network"),
    ("Full system takeover", ["subprocess_execution", "environment_access"],
     ["entire_filesystem", "all_processes", "all_secrets"],
     "Runs arbitrary shell commands with access to secrets"),
    ("Persistent backdoor", ["subprocess_execution", "file_access", "network_access"],
     ["cron_jobs", "startup_scripts", "remote_c2"],
     "Installs persistent access via cron/startup + C2 channel"),
    ("Lateral movement", ["subprocess_execution", "network_access"],
     ["internal_network", "other_servers", "database_hosts"],
     "Uses shell + network to pivot to other internal systems"),
    ("Config tampering", ["file_access", "environment_access"],
     ["app_config", "deployment_settings", "auth_config"],
     "Modifies config files and environment to change app behavior"),
]
CHAIN_POINTS, CHAIN_CAP, DOWNSTREAM_CAP, BLAST_CAP = 5, 25, 30, 100
RISK_BASE_POINTS = {"LOW": 2, "MEDIUM": 5, "HIGH": 10, "CRITICAL": 15}
# Tiers of (points, words); words with an underscore can never match, because
# underscores in the text become spaces first.  Kept as they are.
IMPACT_WORDS = [
    (5, ["delete", "drop", "wipe", "destroy", "purge", "format",
         "transfer_money", "transfer_funds", "send_payment", "pay", "withdraw",
         "shutdown", "terminate", "kill_process"]),
    (3, ["send_email", "send_message", "post_public", "publish", "broadcast",
         "grant_access", "revoke", "admin", "override", "bypass", "escalate",
         "execute_command", "run_shell", "eval_code", "exec_code"]),
    (1, ["update", "modify", "write", "create", "upload", "edit"]),
]
BLAST_LABELS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"), (1, "LOW")]

# --------------------------------------------------------------------- packages
REQUIREMENT_LINE = r"^([A-Za-z0-9_.\-]+)\s*==\s*([A-Za-z0-9_.\-]+)"
ECOSYSTEM = "PyPI"
SUMMARY_LENGTH = 200
NO_SUMMARY = "No summary available"
TRUSTED_PACKAGES = [
    "requests", "flask", "django", "numpy", "pandas", "torch", "tensorflow",
    "boto3", "pytest", "sqlalchemy", "pydantic", "fastapi", "click", "aiohttp",
    "httpx", "cryptography", "pyyaml", "jinja2", "markdown", "beautifulsoup4",
    "selenium", "scrapy", "pillow", "matplotlib", "scikit-learn", "transformers",
    "langchain", "openai", "anthropic", "mcp", "gitpython", "semgrep", "pygit2",
    "urllib3", "certifi", "setuptools", "wheel", "pip", "virtualenv", "black",
    "flake8", "mypy", "tqdm", "python-dotenv", "redis", "celery", "gunicorn",
    "uvicorn", "starlette", "typer", "rich", "pyjwt", "passlib", "bcrypt",
]
TYPOSQUAT_TEXT = (
    "'{package}' closely resembles the well-known package '{resembles}' "
    "(edit distance {distance}) - possible typosquatting."
)

# ---------------------------------------------------------------------- secrets
# The published contract names no formats beyond these; the rest is our choice.
AWS_KEY = r"AKIA[0-9A-Z]{16}"
SECRET_ASSIGNMENT = (
    r"(?:[kK][eE][yY]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[pP][aA][sS][sS][wW][oO][rR][dD])[A-Za-z0-9_.\-]*[ \t]*[:=][ \t]*[\"']([^\"'\s]{16,})[\"']"
)
ENTROPY_MEDIUM, ENTROPY_HIGH = 3.0, 4.5

# ------------------------------------------------------------------------- gate
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4, "RED": 4, "YELLOW": 2}
OVERALL_RANK = {"GREEN": 0, "UNKNOWN": 0, "YELLOW": 1, "RED": 2}
OVERALL_FAIL_RANK = {"RED": 2, "YELLOW": 1, "NEVER": 99}
# Used where a caller leaves a category out.
EVALUATOR_DEFAULTS = {
    "overall": "RED", "secret": "HIGH", "dependency": "HIGH", "typosquat": "LOW",
    "tool": "YELLOW", "injection": "MEDIUM", "shadowing": "HIGH",
}
PRESETS = {
    "default": dict(EVALUATOR_DEFAULTS),
    "strict": {
        "overall": "RED", "secret": "HIGH", "dependency": "HIGH", "typosquat": "MEDIUM",
        "tool": "YELLOW", "injection": "MEDIUM", "shadowing": "HIGH",
    },
    "lenient": {
        "overall": "RED", "secret": "CRITICAL", "dependency": "CRITICAL", "typosquat": "LOW",
        "tool": "RED", "injection": "HIGH", "shadowing": "CRITICAL",
    },
}

# ------------------------------------------------------------------------ badge
BADGE_COLORS = {"GREEN": "#4c1", "YELLOW": "#dfb317", "RED": "#e05d44", "UNKNOWN": "#9f9f9f"}
BADGE_LABELS = {"GREEN": "passing", "YELLOW": "warnings", "RED": "failing", "UNKNOWN": "not scanned"}
BADGE_FALLBACK_LABEL = "unknown"

# ----------------------------------------------------------------------- policy
ACTIONS = ("ALLOW", "BLOCK", "REQUIRE_APPROVAL", "LOG")
POLICY_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DEFAULT_POLICY = {
    "version": "1.0",
    "default_action": "ALLOW",
    "rules": [
        {
            "name": "Block direct rm / delete-all patterns",
            "match": {
                "tool_name_contains": "delete",
                "arg_matches": {"command": r"rm\s+-rf", "path": r"^\/$"},
            },
            "action": "BLOCK",
            "reason": "Command would delete root or perform recursive force deletion.",
            "severity": "CRITICAL",
        },
        {
            "name": "Require approval for subprocess execution",
            "match": {"capability": "subprocess_execution"},
            "action": "REQUIRE_APPROVAL",
            "reason": (
                "Tool can run shell commands -- subprocess execution requires "
                "human approval by default policy."
            ),
            "severity": "HIGH",
        },
        {
            "name": "Require approval for environment variable access",
            "match": {"capability": "environment_access"},
            "action": "REQUIRE_APPROVAL",
            "reason": (
                "Tool reads environment variables which may contain secrets -- "
                "requires human approval."
            ),
            "severity": "HIGH",
        },
        {
            "name": "Block network calls to suspicious hosts",
            "match": {"capability": "network_access", "arg_value_contains": {"url": "0.0.0.0"}},
            "match_type": "any",
            "action": "BLOCK",
            "reason": "Network call to loopback/internal address blocked.",
            "severity": "HIGH",
        },
        {
            "name": "Log file deletion operations",
            "match": {
                "arg_matches": {"path": r"delete|remove|unlink|wipe"},
                "capability": "file_access",
            },
            "action": "LOG",
            "reason": "File deletion operation -- logging for audit trail.",
            "severity": "MEDIUM",
        },
    ],
}

# ----------------------------------------------------------- source extraction
HTTP_VERBS = ("get", "post", "put", "delete", "patch")
NO_DESCRIPTION = "No description found"
UNKNOWN_NAME = "UNKNOWN"
ENUM_CLASS = r"class\s+(\w+)\s*\([^)]*\):\s*\n((?:[ \t]+.*\n?)+)"
ENUM_MEMBER = r"(?m)^\s*(\w+)\s*=\s*[\"']([^\"']+)[\"']"
DECORATED_FUNCTION = (
    r"@(?:mcp\.tool(?:\s*\([^)]*\))?"
    r"|(?:app|router)\.(?:get|post|put|delete|patch)\s*\([^)]*\))"
    r"\s*\n"
    r"(?:[ \t]*@\w+(?:\([^)]*\))?\s*\n)*"
    r"[ \t]*(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[^:]+)?:\s*"
    r"(?:\n[ \t]*(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''))?"
)
DECORATOR_MARKS = ("@mcp.tool", "@app.", "@router.")
NAME_ARGUMENT = r"name\s*=\s*[\"']([^\"']+)[\"']"
DESCRIPTION_ARGUMENT = r"description\s*=\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|[\"']([^\"']+)[\"'])"
TOOL_BLOCK = r"Tool\s*\((.*?)\)\s*,?\s*\n"
TOOL_MARK = "Tool("
BLOCK_NAME = r"name\s*=\s*([^\n,]+),?"
BLOCK_DESCRIPTION_LONG = r"description\s*=\s*\"\"\"(.*?)\"\"\""
BLOCK_DESCRIPTION_SHORT = r"description\s*=\s*\"([^\"]+)\""
QUOTED = r"^[\"'](.+)[\"']$"

JS_MARKS = (".tool(", ".registerTool(", ".addTool(", "description")
JS_CALL = r"\.(?:tool|registerTool|addTool)\s*\("
JS_CALL_NAME = JS_CALL + r"\s*[\"'`]([^\"'`]+)[\"'`]"
JS_CALL_DESCRIPTION = JS_CALL + r"\s*[\"'`][^\"'`]+[\"'`]\s*,\s*[\"'`]([^\"'`]*)[\"'`]"
JS_NAME = r"name\s*:\s*[\"'`]([^\"'`]+)[\"'`]"
JS_DESCRIPTION = r"description\s*:\s*[\"'`]([^\"'`]*)[\"'`]"
JS_OBJECT = (
    r"\{[^{}]*?name\s*:\s*[\"'`]([^\"'`]+)[\"'`][^{}]*?\}"
    r"|\{[^{}]*?description\s*:\s*[\"'`]([^\"'`]+)[\"'`][^{}]*?\}"
)
JS_TYPE_WORDS = ("type", "string", "number", "boolean", "object", "array")

# ------------------------------------------------------------------------- URLs
URL_SHORT = r"^[\w.-]+/[\w.-]+$"
URL_REPO = r"^(https?://github\.com/[\w.-]+/[\w.-]+?)(?:/(?:tree|blob)/.+)?(?:\.git)?/?$"
URL_VALID = r"^https://github\.com/[\w.-]+/[\w.-]+(?:\.git)?/?$"
