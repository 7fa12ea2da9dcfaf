"""The built-in production-risk rules, as rows of operators.rules.

A rule's patterns are searched in whole texts, line starts and ends counting for ^ and $; its
negative patterns silence it for a file that one of them meets.
"""

from __future__ import annotations

from .rules import Rule

SCRIPTS = ("typescript", "javascript", "tsx", "jsx")
PLAIN_SCRIPTS = ("typescript", "javascript")
LARAVEL = ("path:artisan",)

# Id, category, severity, languages, patterns, negative patterns, and what else a rule needs (flags, path_includes, signals).
# Findings are the same only where these are.
_ROWS = (
    ("ts:race:check-then-act", "race-conditions", "warning", SCRIPTS, (r"if\s*\(\s*!\s*await\s+[\w.$]+\.(?:find|findOne|get|exists)\s*\([^)]*\)\s*\)\s*\{[\s\S]{0,400}?await\s+[\w.$]+\.(?:create|insert|save|set)\s*\(",), (), {"flags": "s"}),
    ("ts:race:shared-counter", "race-conditions", "warning", SCRIPTS, (r"^\s*let\s+\w+\s*=\s*0\s*;[\s\S]{0,2000}?\b(?:async\s+function|=>\s*\{)[\s\S]{0,2000}?\w+\s*\+\+",), (), {"flags": "s"}),
    ("py:race:threaded-shared-state", "race-conditions", "warning", ("python",), (r"threading\.Thread\s*\([\s\S]{0,200}?target\s*=",), (r"threading\.(?:Lock|RLock|Semaphore)\s*\(", r"queue\.Queue\s*\("), {}),
    ("go:race:goroutine-loop-capture", "race-conditions", "warning", ("go",), (r"for\s+[^{]{0,120}range\s+[\s\S]{0,40}\{[\s\S]{0,200}?go\s+func\s*\(\s*\)\s*\{[\s\S]{0,200}?\b(?:v|i|item|val|x)\b",), (), {"flags": "s"}),
    ("go:race:map-without-mutex", "race-conditions", "error", ("go",), (r"go\s+func[\s\S]{0,400}?\b\w+\s*\[[^\]]+\]\s*=\s*",), (r"sync\.(?:Mutex|RWMutex|Map)\b",), {"flags": "s"}),
    ("php:race:laravel-balance-update", "race-conditions", "error", ("php",), (r"\$\w+\s*=\s*[A-Z]\w+::(?:find|where)[\s\S]{0,200}?\$\w+->\w+\s*(?:\+=|-=)[\s\S]{0,200}?\$\w+->save\s*\(",), (r"lockForUpdate\s*\(", r"::increment\s*\(", r"::decrement\s*\("), {"flags": "s", "signals": LARAVEL}),
    ("ts:retry:axios-no-idempotency", "retry-duplication", "warning", SCRIPTS, (r"(?:axios-retry|retry|p-retry|async-retry)[\s\S]{0,400}?\baxios\.(?:post|put|patch)\s*\(", r"""\bfetch\s*\([^)]*,\s*\{\s*method\s*:\s*['"]POST['"][\s\S]{0,300}?\}\s*\)[\s\S]{0,200}?\.catch\s*\([\s\S]{0,200}?\bretry\b"""), (r"""['"](?:Idempotency-Key|idempotency_key)['"]""",), {"flags": "s"}),
    ("ts:retry:stripe-no-idempotency", "retry-duplication", "error", SCRIPTS, (r"stripe\.(?:charges|paymentIntents|checkout\.sessions|subscriptions|invoices)\.(?:create|update|capture)\s*\(",), (r"idempotencyKey\s*:", r"""['"]Idempotency-Key['"]"""), {}),
    ("py:retry:requests-retry-post", "retry-duplication", "warning", ("python",), (r"""Retry\s*\([\s\S]{0,300}?(?:method_whitelist|allowed_methods)\s*=\s*\[[^\]]*['"]POST['"]""",), (r"""['"]Idempotency-Key['"]""",), {"flags": "s"}),
    ("php:retry:http-retry-unsafe", "retry-duplication", "warning", ("php",), (r"Http::retry\s*\([^)]*\)(?:\s*->[^;]+)*->(?:post|put|patch)\s*\(",), (r"""['"]Idempotency-Key['"]""",), {"signals": LARAVEL}),
    ("any:retry:webhook-no-dedupe-table", "retry-duplication", "warning", (*SCRIPTS, "php", "python", "go"), (r"\b(?:handle|process|onEvent|webhook)\s*\(",), (r"(?:event|payload)\.id", r"processed_events", r"idempotency"), {"path_includes": ("webhook", "webhooks")}),
    ("php:tx:multi-write-no-transaction", "no-transactions", "error", ("php",), (r"(?:[A-Z]\w+::(?:create|update|delete|insert)\s*\([\s\S]{0,400}?){2,}",), (r"DB::transaction\s*\(", r"DB::beginTransaction\s*\(", r"->getConnection\(\)->transaction\s*\("), {"flags": "s", "signals": LARAVEL}),
    ("ts:tx:prisma-sequence", "no-transactions", "warning", SCRIPTS, (r"(?:await\s+(?:prisma|db|tx)\.[\w.]+\.(?:create|update|delete|upsert)\s*\([\s\S]{0,200}?\)\s*;?\s*){2,}",), (r"\$transaction\s*\(", r"\.transaction\s*\("), {"flags": "s"}),
    ("ts:tx:typeorm-sequence", "no-transactions", "warning", PLAIN_SCRIPTS, (r"(?:await\s+[\w.]+Repository\.(?:save|remove|insert|update)\s*\([\s\S]{0,200}?\)\s*;?\s*){2,}",), (r"\.transaction\s*\(", r"@Transaction\s*\("), {"flags": "s"}),
    ("py:tx:django-no-atomic", "no-transactions", "warning", ("python",), (r"(?:\b\w+\.(?:save|delete)\s*\(\s*\)\s*[\s\S]{0,200}?){2,}", r"(?:\b\w+\.objects\.(?:create|update|delete)\s*\([\s\S]{0,200}?\)\s*[\s\S]{0,200}?){2,}"), (r"transaction\.atomic\b", r"@atomic\b"), {"flags": "s"}),
    ("go:tx:database-sql-multi-exec", "no-transactions", "warning", ("go",), (r"(?:\b(?:db|conn)\.(?:Exec|ExecContext)\s*\([\s\S]{0,200}?\)\s*;?\s*){2,}",), (r"\.BeginTx\s*\(", r"\.Begin\s*\("), {"flags": "s"}),
    ("php:queue:infinite-retry", "bad-queue-retries", "warning", ("php",), (r"class\s+\w+\s+implements\s+ShouldQueue",), (r"public\s+\$tries\s*=\s*\d+", r"public\s+int\s+\$tries", r"public\s+function\s+backoff\s*\("), {"signals": LARAVEL}),
    ("php:queue:no-failed-handler", "bad-queue-retries", "warning", ("php",), (r"class\s+\w+\s+implements\s+ShouldQueue[\s\S]{0,5000}",), (r"public\s+function\s+failed\s*\(",), {"flags": "s", "signals": LARAVEL}),
    ("ts:queue:bullmq-retry-all", "bad-queue-retries", "warning", PLAIN_SCRIPTS, (r"new\s+Worker\s*\(",), (r"UnrecoverableError", r"attemptsMade", r"moveToFailed"), {}),
    ("ts:queue:sqs-no-dlq", "bad-queue-retries", "warning", PLAIN_SCRIPTS, (r"ReceiveMessageCommand|sqs\.receiveMessage\s*\(",), (r"DeadLetterQueue|redrivePolicy|maxReceiveCount",), {}),
    ("py:queue:celery-no-max-retries", "bad-queue-retries", "warning", ("python",), (r"self\.retry\s*\(",), (r"max_retries\s*=", r"autoretry_for\s*="), {}),
    ("any:queue:fire-and-forget", "bad-queue-retries", "info", PLAIN_SCRIPTS, (r"^\s*(?:dispatch|enqueue|queue\.add)\s*\(",), (r"await\s+(?:dispatch|enqueue|queue\.add)\s*\(", r"\.catch\s*\("), {}),
    ("ts:leak:module-scope-map", "memory-leaks", "warning", SCRIPTS, (r"^\s*const\s+\w+\s*=\s*new\s+(?:Map|Set)\s*\(\s*\)\s*;",), (r"lru-cache", r"LRU\s*\(", r"\.(?:delete|clear)\s*\("), {}),
    ("ts:leak:setinterval-no-clear", "memory-leaks", "warning", SCRIPTS, (r"setInterval\s*\(",), (r"clearInterval\s*\(",), {}),
    ("ts:leak:event-emitter-no-off", "memory-leaks", "warning", SCRIPTS, (r"\b(?:process|emitter|bus|io|socket|client)\.on\s*\(",), (r"\.off\s*\(", r"removeListener\s*\(", r"removeAllListeners\s*\("), {}),
    ("react:leak:effect-no-cleanup", "memory-leaks", "warning", SCRIPTS, (r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{[\s\S]{0,600}?(?:setInterval|setTimeout|addEventListener|subscribe)\s*\([\s\S]{0,600}?\}\s*,\s*\[",), (r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{[\s\S]{0,1200}?return\s+\(?\s*\)?\s*=>\s*\{",), {"flags": "s", "signals": ("react",)}),
    ("py:leak:lru-cache-on-self", "memory-leaks", "warning", ("python",), (r"@(?:functools\.)?lru_cache[\s\S]{0,80}\n\s*def\s+\w+\s*\(\s*self\b",), (), {}),
    ("go:leak:unclosed-body", "memory-leaks", "warning", ("go",), (r"(?:resp|r|res)\s*,\s*err\s*:?=\s*\w+\.(?:Get|Post|Do)\s*\(",), (r"defer\s+\w+\.Body\.Close\s*\(\s*\)",), {}),
    ("php:nplus1:foreach-relation", "n-plus-one", "warning", ("php",), (r"foreach\s*\(\s*\$\w+\s+as\s+\$\w+\s*\)\s*\{[\s\S]{0,300}?\$\w+->\w+->\w+",), (r"->with\s*\(", r"->load\s*\("), {"flags": "s", "signals": LARAVEL}),
    ("ts:nplus1:map-await-find", "n-plus-one", "warning", SCRIPTS, (r"\.map\s*\(\s*async\s*[\w(), ]+=>[\s\S]{0,200}?await\s+\w+\.(?:find|findOne|findUnique|get|fetch)\s*\(", r"for\s*\(\s*const\s+\w+\s+of\s+[^)]+\)\s*\{[\s\S]{0,300}?await\s+\w+\.(?:find|findOne|findUnique|get|fetch)\s*\("), (r"findMany\s*\(", r"DataLoader\b", r"Promise\.all\s*\("), {"flags": "s"}),
    ("py:nplus1:django-for-loop-attr", "n-plus-one", "warning", ("python",), (r"for\s+\w+\s+in\s+[\w.]+\.objects[\s\S]{0,60}:\s*\n(?:\s+[^\n]*\n){1,8}?\s+\w+\.\w+\.\w+",), (r"select_related\s*\(", r"prefetch_related\s*\("), {"flags": "s"}),
    ("ts:nplus1:graphql-resolver-no-loader", "n-plus-one", "warning", PLAIN_SCRIPTS, (r"(?:resolve|\w+)\s*:\s*async\s*\([^)]*parent[^)]*\)\s*=>\s*\{[\s\S]{0,200}?await\s+\w+\.(?:find|findOne|findMany|get)\s*\(",), (r"DataLoader\b", r"dataloader"), {"flags": "s", "path_includes": ("resolver", "graphql")}),
    ("php:index:laravel-foreign-no-index", "missing-indexes", "warning", ("php",), (r"""\$table->(?:unsignedBigInteger|bigInteger|integer|foreignId)\s*\(\s*['"](\w+_id)['"][^;]*;""",), (r"->index\s*\(", r"->unique\s*\(", r"->primary\s*\(", r"->constrained\s*\("), {"path_includes": ("database/migrations/", "/migrations/"), "signals": LARAVEL}),
    ("sql:index:create-table-fk-no-index", "missing-indexes", "warning", ("sql",), (r"CREATE\s+TABLE[\s\S]{0,2000}?FOREIGN\s+KEY\s*\(\s*(\w+)\s*\)",), (r"CREATE\s+(?:UNIQUE\s+)?INDEX\b",), {"flags": "si"}),
    ("py:index:django-fk-no-db-index", "missing-indexes", "hint", ("python",), (r"models\.ForeignKey\s*\([\s\S]{0,200}?(?:to_field|db_column)\s*=",), (r"db_index\s*=\s*True", r"indexes\s*="), {"flags": "s", "path_includes": ("models.py", "/models/", "migrations/")}),
    ("ts:index:prisma-relation-no-index", "missing-indexes", "warning", ("*",), (r"@relation\s*\([\s\S]{0,200}?fields\s*:\s*\[(\w+)\]",), (r"@@index\s*\(", r"@unique\b"), {"flags": "s", "path_includes": ("schema.prisma",)}),
    ("php:rl:laravel-route-group-no-throttle", "no-rate-limits", "warning", ("php",), (r"Route::(?:post|put|patch|delete)\s*\(",), (r"throttle\s*:", r"->middleware\s*\([^)]*throttle", r"RateLimiter::for\s*\("), {"path_includes": ("routes/", "/web.php", "/api.php"), "signals": LARAVEL}),
    ("ts:rl:express-no-rate-limit", "no-rate-limits", "warning", PLAIN_SCRIPTS, (r"(?:express\s*\(\s*\)|app\s*=\s*express\s*\(\s*\))",), (r"express-rate-limit", r"rateLimit\s*\(", r"rate-limiter-flexible"), {}),
    ("ts:rl:fastify-no-rate-limit", "no-rate-limits", "hint", PLAIN_SCRIPTS, (r"(?:Fastify\s*\(|fastify\s*\()",), (r"@fastify/rate-limit",), {}),
    ("py:rl:flask-no-rate-limit", "no-rate-limits", "warning", ("python",), (r"Flask\s*\(\s*__name__\s*\)",), (r"flask_limiter", r"Flask-Limiter"), {}),
    ("py:rl:fastapi-no-rate-limit", "no-rate-limits", "hint", ("python",), (r"FastAPI\s*\(",), (r"slowapi", r"Limiter\s*\("), {}),
    ("go:rl:http-handler-no-limiter", "no-rate-limits", "hint", ("go",), (r"http\.ListenAndServe\s*\(",), (r"golang\.org/x/time/rate", r"rate\.NewLimiter\s*\("), {}),
    ("ts:log:console-in-server", "weak-logging", "hint", PLAIN_SCRIPTS, (r"console\.(?:log|debug|info)\s*\(",), (r"pino\b", r"winston\b", r"bunyan\b", r"import\s+\{\s*logger"), {"path_includes": ("server", "api", "handler", "controller", "route")}),
    ("ts:log:swallowed-catch", "weak-logging", "warning", SCRIPTS, (r"catch\s*\(\s*\w*\s*\)\s*\{\s*\}",), (), {}),
    ("any:log:print-in-production", "weak-logging", "hint", ("php", "python"), (r"\b(?:var_dump|print_r|dd|dump)\s*\(", r"^\s*print\s*\("), (), {}),
    ("py:log:bare-except-pass", "weak-logging", "error", ("python",), (r"except(?:\s+Exception)?\s*:\s*(?:\n\s*pass|\s*pass)",), (), {}),
    ("php:log:catch-no-log", "weak-logging", "warning", ("php",), (r"catch\s*\(\s*(?:\\)?\w+\s+\$\w+\s*\)\s*\{\s*\}", r"catch\s*\(\s*(?:\\)?\w+\s+\$\w+\s*\)\s*\{\s*return\s+[^;]{0,120};\s*\}"), (r"Log::(?:error|critical|warning)\s*\(", r"\breport\s*\(\s*\$\w+\s*\)"), {"flags": "s", "signals": ("php:composer",)}),
    ("any:log:secret-logged", "weak-logging", "error", (*SCRIPTS, "python", "php", "go"), (r"(?:console\.log|logger\.\w+|Log::\w+|log\.\w+|logging\.\w+|fmt\.Println)\s*\([^)]*\b(?:password|api_?key|secret|token|authorization)\b",), (), {}),
)

BUILTIN = tuple(Rule(i, c, s, i.rpartition(":")[2].replace("-", " "), p, n, lang, **({"flags": ""} | more)) for i, c, s, lang, p, n, more in _ROWS)
# Languages of a scan by file ending, where they differ from those of an index.
SCAN_LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "php": "php", "py": "python", "go": "go", "swift": "swift", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "cs": "csharp", "sql": "sql", "yml": "yaml", "yaml": "yaml", "json": "json", "vue": "vue", "prisma": "prisma"}
