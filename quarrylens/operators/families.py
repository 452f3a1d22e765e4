"""Rule families: what a line of a file of some kind gives away.

Each family is a tuple of rules for ``rules.line_hits``. Patterns are written for
Java's regular expressions with at most one bounded gap; tokens in order are
sequences (see ``ordered``), so no line costs more than linear work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.operators.ordered import Sequence
from quarrylens.operators.rules import Rule, validated

#: Paths of tests and fixtures, which most rules skip.
TESTS = r"(?i)(^|/)(__tests__|tests?|spec|fixtures?)/|\.(test|spec)\.[a-z]+$"


def in_order(*tokens: str, gap: int = 200, barriers: str = "", across: bool = False) -> Sequence:
    """Tokens that follow one another with at most ``gap`` characters between, none of them a barrier or, unless ``across``, a newline."""
    return Sequence(tokens, gap, barriers, across)


def many_characters(least: int):
    """A value guard: at least ``least`` different characters."""
    return lambda v: F.size(F.array_distinct(F.split(v, ""))) >= least


def real_secret(value: Column) -> Column:
    """Not a placeholder, a variable or a run of one character."""
    return ~value.rlike(r"(?i)example|placeholder|changeme|your[_-]|xxxx|<|\$\{|process\.env") & (F.size(F.array_distinct(F.split(value, ""))) >= 6)


def _rule(id_: str, severity: str, pattern: str | Sequence, **more) -> Rule:
    return Rule(id_, severity, pattern, **({"not_path": TESTS} | more))


FETCH, SHELL = r"\b(?:curl|wget)\b", r"\b(?:ba|z|da)?sh\b"
SEND = r"\b(?:fetch|axios|request|https?\.(?:get|request|post))\b"

FILE = validated((
    _rule("EVAL_ATOB", "critical", in_order(r"\beval\s*\(", r"\batob\s*\(", gap=40)),
    _rule("EVAL_BUFFER", "critical", in_order(r"\beval\s*\(", r"\bBuffer\.from\s*\(", gap=40)),
    _rule("FUNCTION_ATOB", "critical", in_order(r"\bFunction\s*\(", r"\batob\s*\(", gap=40)),
    _rule("EVAL_HEX", "critical", in_order(r"\beval\s*\(", r"(?:\\x[0-9a-fA-F]{2}){4}", gap=80)),
    _rule("EXEC_ENCODED", "high", in_order(r"\bexec(?:Sync)?\s*\(", r"base64|\batob\b", gap=80)),
    _rule("INVISIBLE_UNICODE", "high", r"[\u200b\u200c\u2060\ufe00-\ufe0f]{3}"),
    _rule("HEX_ARRAY", "medium", r"(?:0x[0-9a-fA-F]{2}\s*,\s*){16}"),
    _rule("CHARCODE_OBFUSCATION", "medium", in_order(r"String\.fromCharCode\s*\(", r"(?:\d{2,3}\s*,\s*){8}", gap=20, across=True), spans=8),
    _rule("ENV_EXFILTRATION", "high", in_order(SEND, r"process\.env\b", gap=200, barriers=";")),
    _rule("DNS_EXFILTRATION", "high", in_order(r"\bdns\.(?:lookup|resolve\w*)\s*\(", r"process\.env|os\.hostname|\$\{", gap=120, barriers=";")),
    _rule("CHAIN_RPC_ENDPOINT", "medium", r"https?://[a-z0-9.-]*(?:mainnet|rpc)[a-z0-9.-]*\.(?:com|xyz)\b"),
))

SCRIPTS = validated((
    _rule("SCRIPT_CURL_EXEC", "critical", in_order(r"\bcurl\b", r"\|", SHELL, barriers=";"), flags="i"),
    _rule("SCRIPT_WGET_EXEC", "critical", in_order(r"\bwget\b", r"\||&&", SHELL, barriers=";"), flags="i"),
    _rule("SCRIPT_NODE_INLINE", "high", in_order(r"\bnode\s+(?:-e|--eval)\b", r"require|http|exec", barriers=";"), flags="i"),
    _rule("SCRIPT_ENCODED", "high", r"base64\s+(?:-d|--decode)|\batob\b", flags="i"),
    _rule("SCRIPT_PREINSTALL_EXEC", "medium", r"child_process|execSync|spawnSync", flags="i"),
))

BINARY_DOWNLOAD = validated((
    _rule("BINARY_PREBUILT_FETCH", "medium", r"\b(?:prebuild-install|node-pre-gyp|node-gyp-build)\b", flags="i"),
    _rule("BINARY_CURL_OUTPUT", "high", in_order(FETCH, r"\s-(?:o|O)\s", r"\.(?:exe|bin|node|dll|so)\b", barriers=";"), flags="i"),
    _rule("BINARY_CHMOD_RUN", "high", in_order(r"\bchmod\s+(?:\+x|7[0-7]{2})", r"&&", r"\./", barriers=";"), flags="i"),
))

PYPI = validated((
    _rule("PYPI_OS_SYSTEM", "high", r"\bos\.system\s*\("),
    _rule("PYPI_SUBPROCESS", "high", r"\bsubprocess\.(?:run|call|Popen|check_output)\s*\("),
    _rule("PYPI_EXEC_BASE64", "critical", in_order(r"\bexec\s*\(", r"b64decode", gap=80)),
    _rule("PYPI_EXEC_COMPILE", "high", in_order(r"\bexec\s*\(", r"\bcompile\s*\(", gap=40)),
    _rule("PYPI_MARSHAL_LOADS", "critical", r"\bmarshal\.loads\s*\("),
    _rule("PYPI_EXTRA_INDEX", "medium", r"--(?:extra-)?index-url\s+http"),
    _rule("PYPI_GIT_DEPENDENCY", "medium", r"\bgit\+https?://"),
    _rule("PYPI_ENV_EXFIL", "critical", in_order(r"\brequests\.(?:post|get)\s*\(|urlopen\s*\(", r"os\.environ", gap=120)),
    _rule("PYPI_HOST_EXFIL", "high", in_order(r"\brequests\.(?:post|get)\s*\(|urlopen\s*\(", r"gethostname|getpass\.getuser|platform\.node", gap=120)),
    _rule("PYPI_EXEC_ENCODED", "critical", in_order(r"\bexec\s*\(", r"\.decode\s*\(|\bfromhex\s*\(|\bunhexlify\s*\(", gap=80)),
    _rule("PYPI_EVAL_ENCODED", "critical", in_order(r"\beval\s*\(", r"\bb64decode\s*\(|\bfromhex\s*\(|\bunhexlify\s*\(|\bcodecs\.decode\s*\(", gap=80)),
    _rule("PYPI_EXEC_MARSHAL", "critical", in_order(r"\bexec\s*\(", r"\bmarshal\.loads\s*\(", gap=60)),
    _rule("PYPI_IMPORT_BASE64", "high", r"__import__\s*\(\s*['\"]base64"),
    _rule("PYPI_IMPORT_CODECS", "medium", r"__import__\s*\(\s*['\"]codecs"),
    _rule("PYPI_IMPORT_MARSHAL", "high", r"__import__\s*\(\s*['\"]marshal"),
    _rule("PYPI_URLLIB_FETCH", "high", r"\burl(?:open|retrieve)\s*\(\s*[frb]?['\"]https?:"),
    _rule("PYPI_REQUESTS_FETCH", "medium", r"\brequests\.\w+\s*\(\s*[frb]?['\"]https?:"),
    _rule("PYPI_SUSPICIOUS_INDEX", "critical", r"(?<!extra)-index-url[ =]+https?://(?!(?:test\.)?pypi\.org)"),
    _rule("PYPI_INSTALL_CLASS_OVERRIDE", "medium", r"^\s*class\s+\w+\s*\(\s*(?:\w+\.)*(?:install|develop|egg_info|build_py|sdist)\s*\)"),
))

PYPI_HOOK = validated(tuple(
    _rule(f"PYPI_CMDCLASS_{k.upper()}", "high", in_order(r"cmdclass\s*=\s*\{", rf"['\"]{k}['\"]\s*:", barriers="}", across=True), spans=6)
    for k in ("install", "develop", "build_py", "egg_info", "sdist")
))

BEACON_MINER = validated((
    _rule("BEACON_INTERVAL_FETCH", "high", in_order(r"\bsetInterval\s*\(", SEND, gap=160), flags="i"),
    _rule("MINER_STRATUM", "critical", r"\bstratum2?\+[a-z]{2,5}:/{2}\S", flags="i"),
    _rule("MINER_BINARY", "critical", r"\b(?:xmrig|minerd|cpuminer|nbminer)\b", flags="i"),
    _rule("MINER_POOL_CONFIG", "high", r"[\"'](?:pool|pool_address)[\"']\s*:\s*[\"'][^\"']+:\d{2,5}[\"']", flags="i"),
    _rule("PROTESTWARE_GEO", "critical", in_order(r"(?:geoip|ipapi|ipinfo|country_code)", r"\b(?:rmSync|unlinkSync|rimraf|rm -rf)\b", gap=400, across=True), spans=8, flags="i"),
    _rule("BEACON_TIMEOUT_FETCH", "medium", in_order(r"\bsetTimeout\s*\(", SEND, gap=160), flags="i"),
    _rule("BEACON_WEBSOCKET_EXTERNAL", "medium", r"\bWebSocket\s*\(\s*['\"`]wss?://(?!localhost|127\.|\[?::1)"),
    _rule("MINER_POOL_DOMAIN", "critical", r"\b(?:minexmr|nanopool|supportxmr|hashvault|moneroocean|2miners|nicehash)\.[a-z]{2,8}\b", flags="i"),
    _rule("MINER_LIBRARY_REF", "critical", r"\b(?:coin-?hive|crypto-?loot|cryptonight|webminerpool)\b", flags="i"),
    _rule("MINER_CONFIG_KEYS", "high", in_order(r"['\"](?:donate-level|rig-id|cpu-priority)['\"]\s*:", r"['\"](?:url|user|wallet)['\"]\s*:", across=True), spans=6),
))

BUILD_TOOL = validated((
    _rule("BUILD_PLUGIN_EXEC", "high", in_order(r"\bplugins?\b", r"child_process|execSync", gap=200), flags="i", only_path=r"(?i)(webpack|rollup|vite|babel|gulpfile)[^/]*\.(js|ts|mjs|cjs)$"),
    _rule("BUILD_REMOTE_FETCH", "high", SEND + r"\s*\(\s*['\"]https?://", flags="i", only_path=r"(?i)(webpack|rollup|vite|babel|gulpfile)[^/]*\.(js|ts|mjs|cjs)$"),
    _rule("MONOREPO_ROOT_HOOK", "medium", r"\"(?:pre|post)install\"\s*:", flags="i", only_path=r"(^|/)package\.json$", requires=r"\"workspaces\""),
    _rule("BUILD_ENV_EXFIL", "critical", in_order(SEND, r"\bprocess\.env\b"), only_path=r"(?i)(webpack|rollup|vite|babel|gulpfile)[^/]*\.(js|ts|mjs|cjs)$"),
    _rule("BUILD_DYNAMIC_REQUIRE", "medium", r"\brequire\s*\(\s*[A-Za-z_$][\w$.]*\s*[+)]", only_path=r"(?i)(webpack|rollup|vite|babel|gulpfile)[^/]*\.(js|ts|mjs|cjs)$"),
    _rule("WORKSPACE_PRIVATE_PUBLISH", "high", r"\"publishConfig\"\s*:", only_path=r"(^|/)package\.json$", requires=r"\"private\"\s*:\s*true"),
))

OBFUSCATION = validated((
    _rule("OBF_DYNAMIC_IMPORT", "high", r"\bimport\s*\(\s*(?:atob|Buffer\.from|String\.fromCharCode)\s*\("),
    _rule("OBF_TEMPLATE_EVAL", "high", r"\beval\s*\(\s*`[^`\n]{0,200}\$\{"),
    _rule("OBF_SVG_SCRIPT", "high", r"<script\b", only_path=r"(?i)\.svg$", flags="i"),
    _rule("OBF_BIDI_OVERRIDE", "critical", r"[\u202a-\u202e\u2066-\u2069]"),
    _rule("OBF_SPLIT_STRING", "medium", r"(?:'\w{1,2}' ?\+ ?){4,}'|(?:\"\w{1,2}\" ?\+ ?){4,}\""),
    _rule("OBF_NESTED_DECODE", "critical", in_order(r"\batob\s*\(", r"\batob\s*\(", gap=20)),
    _rule("OBF_PROXY_TRAP", "high", in_order(r"\bnew\s+Proxy\s*\(", r"\b(?:eval|exec|fetch)\b", gap=400, across=True), spans=6),
    _rule("WASM_SUSPICIOUS", "medium", r"\bWebAssembly\.(?:instantiate|compile)\s*\(\s*(?:Buffer\b|new\s+Uint8Array|Uint8Array\b|atob\b)"),
    _rule("STEGANOGRAPHY_DECODE", "high", in_order(r"\bgetImageData\s*\(", r"\bfromCharCode\b|\beval\s*\(|\bFunction\s*\(", across=True), spans=6),
    _rule("CODE_RUNTIME_DEOBFUSCATION", "high", in_order(r"\.split\s*\(\s*(?:''|\"\")\s*\)", r"\.reverse\s*\(\s*\)", r"\.join\s*\(", gap=30)),
))

IAC = validated((
    _rule("IAC_LOCAL_EXEC", "high", r"\bprovisioner\s+\"(?:local|remote)-exec\"", only_path=r"(?i)\.(tf|hcl)$"),
    _rule("IAC_EXTERNAL_MODULE", "medium", r"\bsource\s*=\s*\"(?:https?://|git::)", only_path=r"(?i)\.(tf|hcl)$"),
    _rule("IAC_HARDCODED_SECRET", "critical", r"(?i)\b(?:password|secret|access_key)\s*=\s*\"([^\"$]{8,})\"", only_path=r"(?i)\.(tf|hcl)$", group=1, accept=real_secret),
    _rule("IAC_REMOTE_SCRIPT", "high", in_order(FETCH, r"\|", SHELL), only_path=r"(?i)\.(tf|hcl)$"),
))

INFOSTEALER = validated((
    _rule("STEALER_BROWSER_PATH", "critical", r"(?i)(?:Login Data|Local State|Cookies)['\"]|User Data[\\/]+Default"),
    _rule("STEALER_WALLET_PATH", "critical", r"(?i)\b(?:wallet\.dat|Exodus[\\/]+exodus\.wallet|MetaMask|\.config[\\/]+solana[\\/]+id\.json)"),
    _rule("STEALER_DEAD_DROP", "high", in_order(SEND, r"pastebin\.com/raw|gist\.githubusercontent\.com|t\.me/", gap=120), flags="i"),
    _rule("DROPPER_TEMP_WRITE", "high", in_order(r"\bwriteFile(?:Sync)?\s*\(", r"tmpdir\s*\(|/tmp/|%TEMP%", gap=120)),
    _rule("DEAD_DROP_STEAM", "critical", r"\bsteamcommunity\.com/(?:id|profiles)/\w"),
    _rule("DEAD_DROP_TELEGRAM", "critical", r"\bapi\.telegram\.org/bot|\b(?:t|telegram)\.me/[A-Za-z]\w{3}"),
    _rule("DEAD_DROP_PASTEBIN", "high", r"\b(?:pastebin\.com|paste\.ee|rentry\.co)/(?:raw|r)?/?\w"),
    _rule("DEAD_DROP_DNS_TXT", "medium", in_order(r"\bresolveTxt\s*\(", r"\beval\s*\(|\batob\s*\(|\bBuffer\.from\s*\(", gap=160)),
    _rule("VIDAR_BROWSER_THEFT", "high", in_order(r"Login Data|Web Data|cookies\.sqlite|logins\.json", r"\bCryptUnprotectData\b|\bkey4\.db\b|\bsqlite3?\b")),
    _rule("VIDAR_WALLET_THEFT", "high", in_order(r"(?i:\b(?:electrum|exodus|atomic|metamask|phantom)\b)", r"(?i:\bwallets?\b|\bkeystore\b|\bleveldb\b)", gap=80)),
    _rule("PROXY_BACKCONNECT", "high", in_order(r"\bsocks[45]?\b", r"\b(?:back-?connect|reverse|relay)\b", gap=80), flags="i"),
    _rule("DROPPER_ANTIVM", "high", in_order(r"\b(?:vmware|virtualbox|vboxservice|qemu|sandboxie)\b", r"\b(?:process|sys|os)\._?exit\b", gap=160), flags="i"),
    _rule("DROPPER_SLEEP_EVASION", "high", r"\b(?:setTimeout|sleep|Start-Sleep)\b[^\n]{0,80}?\b\d{6}"),
))

LURE = validated((
    Rule("LURE_DISABLE_ANTIVIRUS", "high", r"(?:disable|turn off)[^\n]{0,40}(?:antivirus|defender)", flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
    Rule("LURE_PASSWORD_ARCHIVE", "high", r"\b(?:archive|zip|rar)\b[^\n]{0,40}\bpassword\b", flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
    Rule("LURE_CRACK", "medium", r"\b(?:crack(?:ed)?|keygen|activator)\b", flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
    Rule("LURE_RUN_AS_ADMIN", "medium", r"run[^\n]{0,20}as (?:an )?administrator", flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
    Rule("README_LURE_LEAKED", "high", r"\bleaked\b[^\n]{0,30}\b(?:source|code|build|model|weights)\b", flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
    Rule("README_LURE_URGENCY", "medium", in_order(r"\bdownload\b", r"\b(?:hurry|limited time|taken down|while you can)\b", gap=80), flags="i", only_path=r"(?i)\.(md|txt|rst)$"),
))

PROMPT_INJECTION = validated((
    Rule("PROMPT_OVERRIDE", "high", r"ignore (?:all )?(?:previous|prior|above) (?:instructions|rules)", flags="i"),
    Rule("PROMPT_CONTROL_TOKEN", "high", r"<\|(?:im_start|im_end|system)\|>|\[/?INST\]"),
    Rule("PROMPT_ROLE_SWITCH", "medium", r"\byou are now (?:in )?(?:a |an )?(?:unrestricted|developer mode|jailbroken)", flags="i"),
    Rule("PROMPT_HIDE_FROM_USER", "high", r"do not (?:tell|inform|mention (?:this )?to) the user", flags="i"),
    Rule("PROMPT_SECRET_REQUEST", "high", r"\b(?:read|send|print|upload)\b[^\n]{0,60}(?:\.env\b|id_rsa|credentials|api keys?)", flags="i"),
))

C2 = validated((
    _rule("C2_DNS_OVER_HTTPS", "medium", r"https://(?:dns\.google|cloudflare-dns\.com|dns\.quad9\.net)/(?:resolve|dns-query)"),
    _rule("C2_GIST_DEAD_DROP", "high", r"gist\.githubusercontent\.com/[^\s'\"]+/raw"),
    _rule("C2_DYNAMIC_CONFIG", "high", in_order(r"JSON\.parse\s*\(", SEND, gap=60)),
    _rule("C2_WEBSOCKET_EXEC", "critical", in_order(r"\bnew\s+WebSocket\s*\(", r"\bexec(?:Sync)?\s*\(|\beval\s*\(", gap=300, across=True), spans=6),
))

SECRETS = validated((
    _rule("SECRETS_CLOUD_KEY_ID", "critical", r"\bAKIA([0-9A-Z]{16})\b", group=1, accept=many_characters(8)),
    _rule("SECRETS_FORGE_TOKEN", "critical", r"\bgh[pousr]_([A-Za-z0-9]{36,})\b", group=1, accept=many_characters(8)),
    _rule("SECRETS_PRIVATE_KEY", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    _rule("SECRETS_REGISTRY_TOKEN", "critical", r"\bnpm_([A-Za-z0-9]{36})\b", group=1, accept=many_characters(8)),
    _rule("SECRETS_ASSIGNED_KEY", "high", r"(?i)\b(?:api[_-]?key|secret|token|passwd|password)\b[\"']?\s*[:=]\s*[\"']([^\"'\s]{16,})[\"']", group=1, accept=real_secret),
    _rule("SECRETS_SSH_KEY_READ", "high", r"\breadFile(?:Sync)?\s*\([^)\n]{0,80}\.ssh/id_"),
))

PROVENANCE = validated((_rule("PROVENANCE_EMPTY_INTEGRITY", "medium", r"\"integrity\"\s*:\s*\"\""),))

CARGO = validated((
    Rule("CARGO_BUILD_RS_EXEC", "critical", r"\bCommand::new\s*\(", only_path=r"(^|/)build\.rs$"),
    Rule("CARGO_BUILD_RS_NETWORK", "high", r"\b(?:reqwest|ureq|hyper|TcpStream)::", only_path=r"(^|/)build\.rs$"),
    Rule("CARGO_BUILD_RS_ENV_EXFIL", "critical", in_order(r"\benv::vars?\s*\(", r"\b(?:reqwest|ureq|TcpStream)\b", barriers=";"), only_path=r"(^|/)build\.rs$"),
    Rule("CARGO_GIT_DEPENDENCY", "medium", r"\bgit\s*=\s*\"", only_path=r"(^|/)Cargo\.toml$"),
    Rule("CARGO_PATCH_SECTION", "high", r"^\[patch\b", only_path=r"(^|/)Cargo\.toml$"),
    Rule("CARGO_REPLACE_SECTION", "high", r"^\[replace\]", only_path=r"(^|/)Cargo\.toml$"),
    Rule("CARGO_PROC_MACRO_FS", "high", r"\bstd::fs::|\bfs::(?:read|write)", only_path=r"(^|/)src/.*\.rs$", requires="proc_macro"),
    Rule("CARGO_PROC_MACRO_NETWORK", "critical", r"\b(?:reqwest|ureq|TcpStream)\b", only_path=r"(^|/)src/.*\.rs$", requires="proc_macro"),
))

GO = validated((
    Rule("GO_REPLACE_DIRECTIVE", "high", r"^\s*(?:replace\s+)?\S+(?:\s+v\S+)?\s+=>\s+\S+", only_path=r"(^|/)go\.mod$"),
    Rule("GO_RETRACT_DIRECTIVE", "medium", r"^\s*retract\b", only_path=r"(^|/)go\.mod$"),
    Rule("GO_INIT_EXEC", "high", in_order(r"\bfunc\s+init\s*\(\s*\)", r"\bexec\.Command\s*\(", gap=400, across=True), spans=8, only_path=r"\.go$"),
    Rule("GO_INIT_NETWORK", "medium", in_order(r"\bfunc\s+init\s*\(\s*\)", r"\bhttp\.(?:Get|Post)\s*\(", gap=400, across=True), spans=8, only_path=r"\.go$"),
    Rule("GO_CGO_IMPORT", "medium", r"^import\s+\"C\"", only_path=r"\.go$"),
    Rule("GO_UNSAFE_IMPORT", "low", r"^\s*(?:import\s+)?\"unsafe\"", only_path=r"\.go$"),
    Rule("GO_PLUGIN_LOAD", "high", r"\bplugin\.Open\s*\(", only_path=r"\.go$"),
    Rule("GO_OS_EXEC", "medium", r"\"os/exec\"", only_path=r"\.go$"),
    Rule("GO_ENV_EXFIL", "high", in_order(r"\bhttp\.(?:Get|Post|PostForm)\s*\(", r"os\.(?:Getenv|Environ)\s*\(", barriers=";"), only_path=r"\.go$"),
))

_DOCKER = {"only_path": r"(?i)(^|/)(?:[^/]*\.)?dockerfile[^/]*$", "exempt": r"^\s*#"}
DOCKERFILE = validated((
    Rule("DOCKER_CURL_PIPE", "critical", in_order(r"\bRUN\b", FETCH, r"\|", SHELL, barriers=";"), **_DOCKER),
    Rule("DOCKER_UNPINNED_BASE", "high", r"^FROM\s+\S+:latest\b", **_DOCKER),
    Rule("DOCKER_NO_TAG", "high", r"^FROM\s+(?!scratch\b)[^\s:@$]+(?:\s+AS\s+\S+)?\s*$", **_DOCKER),
    Rule("DOCKER_HTTP_SOURCE", "high", r"^(?:ADD|RUN)\s.*\bhttp://", **_DOCKER),
    Rule("DOCKER_SECRETS_BUILD", "high", r"(?i)^(?:ARG|ENV)\s+\S*(?:PASSWORD|SECRET|TOKEN|API_KEY)\S*\s*=", **_DOCKER),
    Rule("DOCKER_NPM_GLOBAL", "medium", in_order(r"\bnpm\s+(?:install|i)\b", r"\s-g\b|--global\b", barriers="&;"), **_DOCKER),
    Rule("DOCKER_SUID", "high", r"\bchmod\s+(?:[ug]*\+s|[4267][0-7]{3})\b", **_DOCKER),
    Rule("DOCKER_APT_NO_VERIFY", "high", in_order(r"\bapt(?:-get)?\b", r"--(?:allow-unauthenticated|force-yes)", barriers=";"), **_DOCKER),
))

_CONFIG = {"only_path": r"(^|/)(\.npmrc|\.yarnrc(\.yml)?|pip\.conf|\.pypirc)$", "exempt": r"^\s*[#;]"}
CONFIG = validated((
    Rule("CONFIG_HTTP_REGISTRY", "critical", r"\bregistry\s*[=:]\s*\"?http://", **_CONFIG),
    Rule("CONFIG_CUSTOM_REGISTRY", "high", r"\bregistry\s*[=:]\s*\"?https?://(?!registry\.npmjs\.org|registry\.yarnpkg\.com)", **_CONFIG),
    Rule("CONFIG_AUTH_TOKEN_EXPOSED", "critical", r"_(?:authToken|auth|password)\s*=\s*(?!\$\{)\S{8,}", **_CONFIG),
    Rule("CONFIG_UNSAFE_PERM", "medium", r"\bunsafe-perm\s*=\s*true", **_CONFIG),
    Rule("CONFIG_IGNORE_SCRIPTS_OFF", "low", r"\bignore-scripts\s*=\s*false", **_CONFIG),
    Rule("CONFIG_EXTRA_INDEX", "high", r"\bextra-index-url\s*=", **_CONFIG),
    Rule("CONFIG_TRUSTED_HOST", "high", r"\btrusted-host\s*=", **_CONFIG),
))

_HOOK = {"only_path": r"(^|/)(?:\.git/hooks|\.husky)/[^/]+$", "flags": "i", "exempt": r"^\s*#"}
GIT = validated((
    Rule("GIT_HOOK_DOWNLOAD", "critical", in_order(FETCH, r"https?://", barriers=";"), **_HOOK),
    Rule("GIT_HOOK_EXEC", "high", r"\b(?:eval|exec)\s+[\"'$]", **_HOOK),
    Rule("GIT_HOOK_ENCODED", "critical", r"\bbase64\s+(?:-d|--decode)", **_HOOK),
    Rule("GIT_HOOK_PIPE_SHELL", "high", r"\|\s*(?:ba|z|da)?sh\b", **_HOOK),
    Rule("GIT_SUBMODULE_HTTP", "medium", r"\burl\s*=\s*http://", only_path=r"(^|/)\.gitmodules$"),
    Rule("GIT_SUBMODULE_SUSPICIOUS", "high", r"\burl\s*=\s*\S*(?:\d{1,3}(?:\.\d{1,3}){3}|\.(?:tk|xyz|top)/)", only_path=r"(^|/)\.gitmodules$"),
))

_FLOW = {"only_path": r"(^|/)\.github/workflows/[^/]+\.ya?ml$", "flags": "i", "exempt": r"^\s*#"}
_SECRET, _DECODE = r"\$\{\{\s*secrets\.", r"base64\s+(?:-d|--decode)"
WORKFLOW = validated((
    Rule("GHA_CURL_PIPE_EXEC", "high", in_order(r"\bcurl\b", r"\|", SHELL, barriers=";"), **_FLOW),
    Rule("GHA_WGET_PIPE_EXEC", "high", in_order(r"\bwget\b", r"\|", SHELL, barriers=";"), **_FLOW),
    Rule("GHA_CURL_DOWNLOAD_EXEC", "high", in_order(r"\bcurl\b", r"\s-o\s", r"&&", r"\./|chmod|" + SHELL), **_FLOW),
    Rule("GHA_WGET_DOWNLOAD_EXEC", "high", in_order(r"\bwget\b", r"&&", r"\./|chmod|" + SHELL), **_FLOW),
    Rule("GHA_SECRET_CURL", "high", (in_order(r"\bcurl\b", _SECRET), in_order(_SECRET, r"\bcurl\b")), **_FLOW),
    Rule("GHA_SECRET_WGET", "high", (in_order(r"\bwget\b", _SECRET), in_order(_SECRET, r"\bwget\b")), **_FLOW),
    Rule("GHA_BASE64_PAYLOAD", "high", r"['\"][A-Za-z0-9+/]{80,}={0,2}['\"]", **_FLOW),
    Rule("GHA_BASE64_EXEC", "high", in_order(_DECODE, r"\|", SHELL), **_FLOW),
    Rule("GHA_ATOB_USAGE", "medium", r"\batob\s*\(", **_FLOW),
    Rule("GHA_ENV_EXFIL", "high", in_order(r"\b(?:printenv|env)\b", r"\|", FETCH), **_FLOW),
    Rule("GHA_EVAL_SUBSHELL", "high", r"\beval\s+\"?\$\(", **_FLOW),
    Rule("GHA_EVAL_STRING", "medium", r"\beval\s+['\"](?!\$\()", **_FLOW),
    Rule("GHA_OIDC_WRITE_PERM", "medium", r"\bid-token\s*:\s*write\b", **_FLOW),
    Rule("GHA_CACHE_POISONING", "high", r"\bkey\s*:.*\$\{\{\s*github\.(?:head_ref|event\.pull_request)", **_FLOW),
    Rule("GHA_SELF_MODIFY", "critical", in_order(r"(?:>|\btee\b|\bcp\b|\bsed\s+-i)", r"\.github/workflows/"), **_FLOW),
))

_EDITOR = {"only_path": r"\.(js|ts|mjs|cjs)$", "requires": r"['\"]vscode['\"]"}
VSCODE = validated((
    _rule("VSCODE_EXEC", "high", r"\b(?:child_process|execSync|spawn)\b", only_path=r"\.(js|ts)$"),
    _rule("VSCODE_TERMINAL_SEND", "high", in_order(r"\bcreateTerminal\b|\bterminal\b", r"\.sendText\s*\(", gap=80), only_path=r"\.(js|ts)$"),
    _rule("VSCODE_SECRET_STORAGE", "medium", r"\bcontext\.secrets\.get\s*\(", only_path=r"\.(js|ts)$"),
    _rule("VSCODE_STARTUP_ACTIVATION", "low", r"\"activationEvents\"\s*:\s*\[[^\]]*\"\*\"", only_path=r"(^|/)package\.json$"),
    _rule("VSCODE_HEX_NAMES", "medium", r"\b_0x[0-9a-f]{4,}\b", only_path=r"\.(js|ts)$"),
    _rule("VSCODE_EVAL", "high", r"\beval\s*\(", **_EDITOR),
    _rule("VSCODE_FUNCTION_CONSTRUCTOR", "high", r"\bnew\s+Function\s*\(", **_EDITOR),
    _rule("VSCODE_CHILD_PROCESS", "medium", r"['\"](?:node:)?child_process['\"]", **_EDITOR),
    _rule("VSCODE_NETWORK", "low", r"\brequire\s*\(\s*['\"](?:node:)?(?:https?|net|tls|dgram)['\"]", **_EDITOR),
    _rule("VSCODE_ENV_ACCESS", "low", r"\bprocess\.env\b", **_EDITOR),
    _rule("VSCODE_FILE_WRITE", "low", r"\bfs\.(?:promises\.)?(?:write|append|createWrite)\w*\s*\(", **_EDITOR),
    _rule("VSCODE_BASE64", "medium", r"\batob\s*\(|,\s*['\"]base64['\"]\s*\)", **_EDITOR),
    _rule("VSCODE_CHARCODE", "medium", r"\bfromCharCode\s*\(", **_EDITOR),
    _rule("VSCODE_HEX_STRINGS", "medium", r"(?:\\x[0-9a-fA-F]{2}){6}", **_EDITOR),
))


def private_address(value: Column) -> Column:
    from quarrylens.functions.scalars import ipv4_class

    return ipv4_class(value) == "private"


# Suffixes of names that resolve inside a network only.
INTERNAL_SUFFIXES = "internal|intranet|corp|lan|local|home\\.arpa"
INTERNAL = validated((
    _rule("INTERNAL_PRIVATE_IP", "medium", r"(?<![0-9.])((?:\d{1,3}\.){3}\d{1,3})(?![0-9.])", group=1, accept=private_address),
    _rule("INTERNAL_PRIVATE_IPV6", "medium", r"(?i)(?<![0-9a-f:])f[cd][0-9a-f]{2}:[0-9a-f:]{2,}"),
    _rule("INTERNAL_HOSTNAME", "medium", rf"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{INTERNAL_SUFFIXES})\b"),
    _rule("INTERNAL_SINGLE_LABEL_URL", "low", r"(?i)\bhttps?://(?!localhost\b)[a-z][a-z0-9-]*(?=[:/\s'\"]|$)"),
    _rule("INTERNAL_GIT_REMOTE", "medium", r"\bgit@(?!(?:github|gitlab|bitbucket)\.)[A-Za-z0-9.-]+:"),
    _rule("INTERNAL_DEV_PATH", "low", r"(?:/Users|/home)/(?!user\b|runner\b|node\b|app\b)[a-z][a-z0-9._-]+/|[A-Z]:\\Users\\(?!Public\b)[A-Za-z]"),
))

FAMILIES: dict[str, tuple[Rule, ...]] = {
    "file": FILE, "scripts": SCRIPTS, "binary_download": BINARY_DOWNLOAD, "pypi": PYPI, "pypi_hook": PYPI_HOOK, "beacon_miner": BEACON_MINER,
    "build_tool": BUILD_TOOL, "obfuscation": OBFUSCATION, "iac": IAC, "infostealer": INFOSTEALER, "lure": LURE, "prompt_injection": PROMPT_INJECTION,
    "c2": C2, "secrets": SECRETS, "provenance": PROVENANCE, "cargo": CARGO, "go": GO, "dockerfile": DOCKERFILE, "config": CONFIG, "git": GIT,
    "workflow": WORKFLOW, "vscode": VSCODE, "internal": INTERNAL,
}
EVERY = validated(tuple(r for family in FAMILIES.values() for r in family))
