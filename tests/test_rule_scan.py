"""Rule scans: literals of patterns, one hit and one miss for each built-in rule, detectors and instructions branch by branch."""

import random
import re
import time

import pytest

from tessera.functions import literals
from tessera.operators import detectors, instructions, rules
from tessera.operators.risk_rules import BUILTIN

# A text that each rule finds, and what silences it there (or, where nothing does, a text that it passes over).
SAMPLES = {
    "ts:race:check-then-act": ("if (!await repo.findOne({ id })) {\n  await repo.save(x)\n}", "!if (!repo.find(id)) { await repo.save(x) }"),
    "ts:race:shared-counter": ("let n = 0;\nasync function f() { n++ }", "!const n = 0;\nasync function f() { n++ }"),
    "py:race:threaded-shared-state": ("t = threading.Thread(name='a', target=f)", "threading.Lock()"),
    "go:race:goroutine-loop-capture": ("for _, v := range items {\n  go func() { use(v) }()\n}", "!for _, v := range items {\n  use(v)\n}"),
    "go:race:map-without-mutex": ("go func() { seen[key] = true }()", "var mu sync.Mutex"),
    "php:race:laravel-balance-update": ("$a = Account::find(1); $a->balance -= 5; $a->save();", "$q->lockForUpdate()"),
    "ts:retry:axios-no-idempotency": ("retry(() => axios.post(url, x))", "'Idempotency-Key'"),
    "ts:retry:stripe-no-idempotency": ("stripe.charges.create({ amount: 1 })", "idempotencyKey: k"),
    "py:retry:requests-retry-post": ("Retry(3, allowed_methods=['POST'])", "'Idempotency-Key'"),
    "php:retry:http-retry-unsafe": ("Http::retry(3)->acceptJson()->post($url)", "'Idempotency-Key'"),
    "any:retry:webhook-no-dedupe-table": ("handle(request)", "payload.id"),
    "php:tx:multi-write-no-transaction": ("Order::create($a); Item::insert($b);", "DB::transaction(fn () => 1)"),
    "ts:tx:prisma-sequence": ("await prisma.order.create({});\nawait prisma.item.create({});", "prisma.$transaction([])"),
    "ts:tx:typeorm-sequence": ("await this.orderRepository.save(a);\nawait this.itemRepository.save(b);", "m.transaction(f)"),
    "py:tx:django-no-atomic": ("a.save()\nb.save()", "with transaction.atomic():"),
    "go:tx:database-sql-multi-exec": ("db.Exec(q)\ndb.Exec(r)", "db.Begin()"),
    "php:queue:infinite-retry": ("class A implements ShouldQueue {}", "public $tries = 3;"),
    "php:queue:no-failed-handler": ("class A implements ShouldQueue {}", "public function failed($e) {}"),
    "ts:queue:bullmq-retry-all": ("const w = new Worker('q', f)", "throw new UnrecoverableError()"),
    "ts:queue:sqs-no-dlq": ("new ReceiveMessageCommand({})", "maxReceiveCount: 3"),
    "py:queue:celery-no-max-retries": ("self.retry(exc=e)", "max_retries = 3"),
    "any:queue:fire-and-forget": ("  dispatch(job)", ".catch(log)"),
    "ts:leak:module-scope-map": ("const seen = new Map();", "seen.clear()"),
    "ts:leak:setinterval-no-clear": ("setInterval(f, 5)", "clearInterval(t)"),
    "ts:leak:event-emitter-no-off": ("socket.on('x', f)", "socket.off('x', f)"),
    "react:leak:effect-no-cleanup": ("useEffect(() => { setInterval(f, 5); }, [])", "useEffect(() => { return () => { } })"),
    "py:leak:lru-cache-on-self": ("@lru_cache(maxsize=1)\ndef f(self):", "!@lru_cache(maxsize=1)\ndef f(x):"),
    "go:leak:unclosed-body": ("resp, err := http.Get(u)", "defer resp.Body.Close()"),
    "php:nplus1:foreach-relation": ("foreach ($a as $b) { echo $b->author->name; }", "$q->with('author')"),
    "ts:nplus1:map-await-find": ("ids.map(async (i) => { await repo.find(i) })", "Promise.all(x)"),
    "py:nplus1:django-for-loop-attr": ("for b in Book.objects.all():\n  x = 1\n  b.author.name", "q.select_related('author')"),
    "ts:nplus1:graphql-resolver-no-loader": ("author: async (parent, a) => { await db.find(parent.id) }", "new DataLoader(f)"),
    "php:index:laravel-foreign-no-index": ("$table->bigInteger('user_id');", "$table->index('user_id');"),
    "sql:index:create-table-fk-no-index": ("create table a (b int, foreign key (b) references c)", "create index i on a (b)"),
    "py:index:django-fk-no-db-index": ("models.ForeignKey(A, db_column='a')", "db_index = True"),
    "ts:index:prisma-relation-no-index": ("a A @relation(fields: [aId])", "@@index([aId])"),
    "php:rl:laravel-route-group-no-throttle": ("Route::post('/a', f);", "throttle:60"),
    "ts:rl:express-no-rate-limit": ("const app = express()", "rateLimit({})"),
    "ts:rl:fastify-no-rate-limit": ("Fastify({})", "import '@fastify/rate-limit'"),
    "py:rl:flask-no-rate-limit": ("app = Flask(__name__)", "from flask_limiter import L"),
    "py:rl:fastapi-no-rate-limit": ("app = FastAPI()", "Limiter(key)"),
    "go:rl:http-handler-no-limiter": ("http.ListenAndServe(a, nil)", "rate.NewLimiter(1, 1)"),
    "ts:log:console-in-server": ("console.log(x)", "winston"),
    "ts:log:swallowed-catch": ("try { f() } catch (e) { }", "!try { f() } catch (e) { g() }"),
    "any:log:print-in-production": ("dd($x)", "!add($x)"),
    "py:log:bare-except-pass": ("try:\n  f()\nexcept Exception:\n  pass", "!try:\n  f()\nexcept Exception:\n  raise"),
    "php:log:catch-no-log": ("try { f(); } catch (E $e) { return null; }", "Log::error($e)"),
    "any:log:secret-logged": ("logger.info('password', p)", "!logger.info('size', p)"),
}


def test_every_builtin_rule_hits_and_is_silenced(spark):
    assert set(SAMPLES) == {r.id for r in BUILTIN}
    files = []
    for r in BUILTIN:
        hit, miss = SAMPLES[r.id]
        path = f"{r.path_includes[0] if r.path_includes else 'src'}/{r.id.replace(':', '/')}"
        language = "go" if r.languages == ("*",) else r.languages[0]
        files += [(f"{path}/hit", language, f"// one\n\n{hit}\n"), (f"{path}/miss", language, miss[1:] if miss.startswith("!") else f"{hit}\n{miss}\n"), (f"{path}/other", "cobol", hit)]
    df = spark.createDataFrame(files, "path string, language string, text string")
    found = {(r.rule_id, r.path, r.line) for r in rules.scan(df, list(BUILTIN)).collect()}
    own = {f for f in found if f[0].replace(":", "/") in f[1]}
    late = {"py:log:bare-except-pass": 5}
    for r in BUILTIN:
        mine = {(p.rsplit("/", 1)[1], n) for i, p, n in own if i == r.id}
        spoken = {"hit", "other"} if r.languages == ("*",) else {"hit"}
        assert {where for where, _ in mine} == spoken, r.id
        assert {n for where, n in mine if where == "hit"} <= {2, late.get(r.id, 3)}, (r.id, mine)  # ^\s* may begin at the blank line


def test_scan_equals_plain_search(spark):
    """Generated texts through the prefilter against every pattern searched for itself."""
    rng = random.Random(17)
    pieces = [x for hit, miss in SAMPLES.values() for x in (hit, miss.lstrip("!"))] + ["\n", " ", "dump(1)", "print(2)", "é ", "﷐"]
    own = [r for r in BUILTIN if "python" in r.languages]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(f"webhook/models.py/{i}", "python", t) for i, t in enumerate(texts)], "path string, language string, text string")
    got = sorted((r.rule_id, r.path, r.line, r.evidence) for r in rules.scan(df, own).collect())
    want = set()
    for i, t in enumerate(texts):
        t = t.replace("﷐", " ")
        for r in own:
            flags = re.M | re.A | (re.S if "s" in r.flags else 0) | (re.I if "i" in r.flags else 0)
            if any(re.search(p, t, flags) for p in r.negative):
                continue
            for p in r.patterns:
                for m in re.finditer(p, t, flags):
                    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", m[0]).strip(" ")
                    want.add((r.id, f"webhook/models.py/{i}", t.count("\n", 0, m.start()) + 1, flat if len(flat) <= 240 else flat[:237] + "..."))
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) > 40
    assert set(got) == want


def test_scan_is_linear_in_matches(spark):
    own = [r for r in BUILTIN if r.id == "any:log:print-in-production"]
    text = "dump(1)\nprint(2)\n" * 8_000
    df = spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")
    rules.scan(df.limit(0), own).count()
    begun = time.time()
    assert rules.scan(df, own).count() == 16_000
    assert time.time() - begun < 20  # seconds, on a busy machine; quadratic work took minutes


def test_literals_of_patterns():
    assert literals.required(r"setInterval\s*\(") == {"setinterval"}
    assert literals.required(r"(?:axios-retry|retry)[\s\S]{0,400}?\baxios\.(?:post|put)\s*\(") == {"axios."}
    assert literals.required(r"a?b?\w+") is None and literals.required(r"(?:abc|d)") is None and literals.required(r"(?!never)x*") is None
    assert literals.required(r"(?:abc|defg)+") == {"abc", "defg"} and literals.required(r"[abc]{3}zebra{2}s") == {"zebra"}
    rng = random.Random(4)
    for _ in range(300):  # whatever matches holds one of them
        atoms = [rng.choice(["abc", "x?", "(?:lion|tiger)", "[a-z]", r"\d+", "wolf{1,2}", "(?:ab)*", r"\(", "^", "(?=q)?", "."]) for _ in range(rng.randint(1, 6))]
        need = literals.required("".join(atoms))
        text = "".join({"x?": "", "(?:lion|tiger)": rng.choice(["lion", "tiger"]), "[a-z]": "k", r"\d+": "77", "wolf{1,2}": rng.choice(["wolf", "wolff"]), "(?:ab)*": "", r"\(": "(", "^": "", "(?=q)?": "", ".": "-"}.get(a, a) for a in atoms)
        assert need is None or any(n in text for n in need), (atoms, need, text)
    found = re.compile(literals.finder(frozenset(["retry", "axios-retry", "ret", "x.y"])))
    assert [m[1] for m in found.finditer("axios-retry, ret x.y xzy")] == ["axios-retry", "retry", "ret", "x.y"]


EDGES = "from_path string, to_path string, kind string, specifier string, start_line int, confidence string, method string"


def told(spark, files, rule, edges=()):
    out = detectors.conflicts(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(list(edges), EDGES), [rule])
    return sorted((r.path, r.line, r.detail, r.confidence) for r in out.collect())


def test_detectors_branch_by_branch(spark):
    rule = detectors.ConflictRule
    code = "// note\nimport a from 'left-pad';\nconst b = require(\"@acme\\\\db\")\nimport 'left-pad'; import 'left-pad'\n"
    got = told(spark, [("src/a.ts", code), ("lib/a.ts", code), ("src/n.ts", None)], rule("r", "forbidden_imports", ("src/**",), ("left-pad",)))
    assert got == [("src/a.ts", n, "Imports `left-pad` (forbidden: `left-pad`)", "medium") for n in (2, 4)]  # equal hits of a line are one
    edges = [("src/a.ts", "x", "import", "left-pad/sub", 9, "low", "ast"), ("src/a.ts", "x", "import", "left-pad", 8, "low", "heuristic"), ("src/a.ts", "x", "call", "left-pad", 7, "high", "ast"), ("src/a.ts", "x", "require", "left-pad", None, "low", None)]
    assert told(spark, [("src/a.ts", code)], rule("r", "forbidden_imports", ("src/**",), ("left-pad",)), edges) == [("src/a.ts", 1, "Imports `left-pad` (forbidden: `left-pad`)", "high"), ("src/a.ts", 9, "Imports `left-pad/sub` (forbidden: `left-pad`)", "high")]
    db = rule("r", "direct_database_access", ("**",), ("@acme/db",), ("db.",))
    assert told(spark, [("a.ts", "import x from '@acme/db';\ndb.a(); db.b()\n  # db.c\n* db.d\nx // db.e")], db) == [("a.ts", 1, "Direct database import `@acme/db`", "medium"), ("a.ts", 2, "Direct database usage `db.`", "high"), ("a.ts", 5, "Direct database usage `db.`", "high")]
    assert told(spark, [("a.ts", "import s from 'stripe'")], rule("r", "network_provider_access", ("**",), ("stripe",))) == [("a.ts", 1, "Network provider import `stripe`", "medium")]
    folder = rule("r", "prohibited_directory_deps", ("**",), ("infra/",))
    assert told(spark, [("a.ts", "import s from '../infra/db'")], folder, [("a.ts", "src\\infra\\q.ts", "require", "q", 3, "low", "heuristic")]) == [("a.ts", 1, "Depends on prohibited directory `infra` via `../infra/db`", "high"), ("a.ts", 3, "File dependency into prohibited directory `src/infra/q.ts`", "high")]
    assert told(spark, [("x/a.ts", ""), ("x/b.ts", "")], rule("r", "naming_rules", ("**",), ("^a",))) == [("x/b.ts", 1, "Basename `b.ts` does not match required pattern /^a/", "high")]
    assert told(spark, [("x/a.ts", ""), ("x/b.ts", "")], rule("r", "naming_rules", ("**",), ("^a",), (), False)) == [("x/a.ts", 1, "Basename `a.ts` matches prohibited pattern /^a/", "high")]
    tests = rule("r", "required_test_location", ("src/**",), ("tests/**",))
    paths = ["src/order.ts", "src/order.test.ts", "src/cart.ts", "tests/deep/my-cart.spec.ts", "src/user.ts", "other/user.test.ts", "src/a-rather-long-name.ts", "tests/a-rather-long-nape.test.ts", "top.ts"]
    assert told(spark, [(p, "") for p in paths], tests) == [(p, 1, "No matching test found for required globs: tests/**", "medium") for p in ("src/a-rather-long-name.ts", "src/user.ts")]
    assert told(spark, [("src/user.ts", "")], rule("r", "required_test_location", ("src/**",), ())) == []
    env = rule("r", "environment_variable_access", ("**",), ("KEY",))
    assert told(spark, [("a.ts", "x\ny = process.env.KEY\nprocess.env.KEY"), ("b.php", "// getenv('KEY')\ngetenv('KEY')"), ("c.rb", "ENV[\"KEY\"]")], env) == [("a.ts", 2, "Reads environment variable via `process.env.KEY`", "high"), ("c.rb", 1, 'Reads environment variable via `ENV["KEY"]`', "high")]
    assert told(spark, [("a.ts", "new Gateway()"), ("b.ts", "x"), ("c.ts", None)], rule("r", "required_abstraction", ("**",), ("Gateway", "Facade"))) == [(p, 1, "Missing required abstraction(s): `Gateway`, `Facade`", "medium") for p in ("b.ts", "c.ts")]
    assert told(spark, [("a.ts", "")], rule("r", "unknown", ("**",), ())) == []


CASES = [
    ("Controllers must not use Prisma directly", "direct_database_access", "prisma", 3, {"databaseAccessPatterns": ["PrismaClient", "prisma."], "forbiddenImports": ["@prisma/client"]}),
    ("Nobody may not query through doctrine", "direct_database_access", "prisma", 2, {"databaseAccessPatterns": ["PrismaClient", "prisma."], "forbiddenImports": ["@prisma/client"]}),
    ("Never import `lodash` anywhere", "forbidden_imports", "lodash", 1, {"forbiddenImports": ["lodash"]}),
    ("Services do not require @acme/db.", "forbidden_imports", "@acme/db.", 1, {"forbiddenImports": ["@acme/db."]}),
    ("Handlers must use the OrderService instead of models", "required_abstraction", "OrderService", 1, {"requiredAbstractions": ["OrderService"]}),
    ("Handlers should go through 'pay/BillingGateway' rather than tables", "required_abstraction", "pay/BillingGateway", 1, {"requiredAbstractions": ["pay/BillingGateway"]}),
    ("Never depend on src/infra/*", "prohibited_directory_deps", "src/infra/", 1, {"prohibitedDirectories": ["src/infra/"]}),
    ("Screens don't depend on from internals", "prohibited_directory_deps", "internals", 1, {"prohibitedDirectories": ["internals"]}),
    ("Classes must be named *.service.ts", "naming_rules", "*.service.ts", 1, {"namingPattern": [r"^.*\.service\.ts$"], "namingMustMatch": ["true"]}),
    ("Tests must live next to the code", "required_test_location", instructions.ANY_TEST, 1, {"requiredTestGlobs": [instructions.ANY_TEST]}),
    ("Specs belong there and must match \"a/*.spec.ts\"", "required_test_location", "a/*.spec.ts", 1, {"requiredTestGlobs": ["a/*.spec.ts"]}),
    ("UI code must not call Stripe itself", "network_provider_access", "stripe", 2, {"networkProviderPatterns": ["stripe"]}),
    ("Views must not read process.env.SECRET_KEY", "environment_variable_access", "SECRET_KEY", 1, {"environmentVariablePatterns": ["SECRET_KEY"]}),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][:30])
def test_instructions_branch_by_branch(case):
    text, detector, subject, scopes, fields = case
    got = instructions.rule_of(text)
    assert (got["detector"], got["subject"], got["ambiguous"], len(got["applies_to"]), got["fields"]) == (detector, subject, False, scopes, fields)
    assert detectors.rule_from("x", detector, got["applies_to"], fields).detector == detector


def test_instructions_that_tell_nothing(spark):
    assert instructions.rule_of("Never put specs next to it")["ambiguous"] is True  # nothing says where they belong
    assert instructions.rule_of("You should write clearly, please") == {"detector": "forbidden_imports", "subject": "", "ambiguous": True, "applies_to": [], "fields": {}}
    assert instructions.rule_of("Write clearly, please do") is None and instructions.rule_of("never so") is None and instructions.rule_of(None) is None
    assert instructions.rule_of("Handlers must use the OrderService for all models")["ambiguous"]  # no contrast
    assert instructions.rule_of("Tests must be named x.test.ts")["applies_to"] == [instructions.ANY_TEST]
    df = spark.createDataFrame([(1, "Never import lodash anywhere", "own"), (2, None, "own"), (3, "hello there, world", "own")], "id int, text string, subject string")
    got = instructions.mapped(df).orderBy("id").collect()
    assert [(r.id, r.detector, r.subject) for r in got] == [(1, "forbidden_imports", "lodash"), (2, None, None), (3, None, None)]
    assert instructions.mapped(df.limit(0)).count() == 0


def test_scope_of_tests_tells_case_apart_in_file_names():
    scope = lambda text: instructions.rule_of(text)["applies_to"]
    routes = ["**/routes/**", "**/http/routes/**"]
    assert scope("Routes must be named *.TEST.ts") == routes
    assert scope("Routes must be named *.test.ts") == scope("Routes of Tests must be named *.x.ts") == scope("Routes must be named *.x.ts, TESTS too") == [*routes, instructions.ANY_TEST]
