import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


FILES = {
    "src/billing.py": '''"""Billing."""


class Meter:
    """Counts usage."""

    def __init__(self, unit: str):
        self.unit = unit

    def read_total(self, key: str) -> int:
        """Total of a key."""
        return 1


class Invoicer(Meter):
    """Writes invoices."""

    def __init__(self, meter: Meter):
        self.meter = meter

    def issue(self, key: str) -> bool:
        """Issues an invoice."""
        total = self.meter.read_total(key)
        return self.check_total(total)

    def check_total(self, total: int) -> bool:
        return total > 0
''',
    "app/Desk.kt": '''package com.demo.desk

/** Front desk. */
class Desk(private val invoicer: Invoicer, private val stock: Stock) {
    fun checkout(key: String): Boolean {
        stock.hold(key)
        return invoicer.issue(key)
    }
}
''',
    "auth/Login.java": '''package com.demo.auth;

/**
 * Logs users in.
 */
public class Login {
    private final Vault vault;

    public Login(Vault vault) {
        this.vault = vault;
    }

    public String renewLoginToken(String token) {
        vault.revoke(token);
        return vault.mint("user");
    }
}
''',
    "ios/Login.swift": '''public class LoginView: View {
    func renew(token: String) -> String {
        return vault.mint(token: token)
    }
}
''',
    "docs/guide.md": '''# Guide

## Billing

Invoices come from `Invoicer` in the billing module.

### Retry rules

Failed invoices are retried.

## Login

See `Login` for token renewal.
''',
    "tests/test_billing.py": '''def test_issue(invoicer):
    assert invoicer.issue("k")
''',
    "build/skipped.py": "x = 1\n",
    ".hidden/skipped.py": "x = 1\n",
    "src/__init__.py": "",
    "notes.txt": "not indexed",
}


@pytest.fixture(scope="session")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return root


@pytest.fixture(scope="session")
def index(spark, repo):
    from codeloom.engine import CodeIndex
    engine = CodeIndex(spark, repo)
    engine.first_counts = engine.index()
    return engine
