"""A small project indexed, refreshed and queried end to end; templates and packs."""

import datetime as dt

import pytest

from tessera.operators import context
from tessera.operators.rules import Rule
from tessera.plans.api import QueryError, ProjectIndex

FILES = {
    "src/billing/refunds.ts": "import { charge } from './charge';\nexport function refundOrder(id) {\n  return charge(-id);\n}\n",
    "src/billing/charge.ts": "export function charge(x) {\n  return fetch('/pay');\n}\n",
    "src/billing/refunds.test.ts": "import { refundOrder } from './refunds';\n",
    "docs/README.md": "# Billing\n\nRefunds go through charge.\n",
    "secrets/key.md": "hidden refund\n",
    "app/Order.php": "<?php\nclass Order {\n  public function total() { return $this->sum(); }\n  public function sum() { return 1; }\n}\n",
    ".gitignore": "ignored/\n",
    "ignored/x.ts": "export const nothing = 1;\n",
}


def test_project_index(spark, tmp_path):
    root = tmp_path / "project"
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    index = ProjectIndex(spark, str(root), str(tmp_path / "index"))
    with pytest.raises(QueryError) as empty:
        index.search("x")
    assert empty.value.code == "empty_index"
    assert index.refresh() == 1
    assert {r.path for r in index.table("files").collect()} == {"src/billing/refunds.ts", "src/billing/charge.ts", "src/billing/refunds.test.ts", "docs/README.md", "app/Order.php"}
    hits = index.search("refundOrder", for_model=True).collect()
    assert max(hits, key=lambda h: h.score).path == "src/billing/refunds.ts" and not any("secrets" in h.path for h in hits)
    assert index.symbol("sum").first().callers == 1
    with pytest.raises(QueryError):
        index.symbol("nobody")
    assert "src/billing/charge.ts" in {r.node for r in index.impact("src/billing/refunds.ts").collect()}
    assert index.related("src/billing/refunds.ts", "charge").count() > 0
    assert index.risks([Rule("net", "network", "warning", "t", (r"fetch\(",))]).first().path == "src/billing/charge.ts"

    before = {r.id for r in index.table("chunks").collect()}
    index.refresh()  # nothing changed: the same tables
    assert {r.id for r in index.table("chunks").collect()} == before
    (root / "docs/README.md").write_text("# Invoices\n\nOther words.\n")
    (root / "app/Order.php").unlink()
    index.refresh()
    assert "app/Order.php" not in {r.path for r in index.table("symbols").collect()}
    assert any("Invoices" in r.text for r in index.table("chunks").collect())
    assert index.status().first().files == 4

    pack = index.context_pack("Fix refundOrder", "bug-fix")
    text = pack.markdown("2024-01-01T00:00:00Z")
    assert context.has_sections(text, pack.template) and context.parse_frontmatter(text)[0]["template"] == "bug-fix" and "refunds.ts" in text


def test_templates():
    own = context.parse_template("---\nname: Mine\nbase: review\nmax_files: 999\napi_key: x\nsections:\n  - risks\n  - nonsense\n---\nbody", "mine")
    assert own.name == "Mine" and own.max_files == 40 and own.sections == ("task", "risks") and "api_key" not in own.extra
    assert context.resolve_template("mine", {"mine": "---\ndepth: deep\n---"}).max_chars == 60_000 and context.resolve_template("zzz").id == "default"
    assert context.file_name("Fix: the Thing!", dt.datetime(2024, 1, 2, 3, 4, 5)) == "20240102-030405-fix-the-thing.md"
    pack = context.Pack(context.Template("t", "T", ("task", "files"), max_chars=30), "x", {"task": ["x"], "files": ["a" * 10, "b" * 40, "c"]})
    assert "truncated: true" in (pack.markdown("now"), pack.markdown("now"))[1] and context.describe(context.BUILTIN["review"])["titles"][0] == "Task"
