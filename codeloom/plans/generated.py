"""Source files written row by row from the benchmark tables, to run the parsers over whole tables.

Every part is a Java file, every supplier a Kotlin file, every customer a Swift file, every
order a Python file and every document a Markdown file that holds its whole text.
"""

from pyspark.sql import Column, DataFrame, functions as F

TEMPLATES = {
    "java": """package com.acme.{brand};

/**
 * {type} part.
 */
public class Part{k} extends Base{brand} implements {type}Item {
    private int size = {size};

    /** Ships the part. */
    @Override
    public Map<String, Integer> ship{size}(int count, String note) {
        if (count > {size}) {
            return store{brand}.reserve{size}(count);
        }
        return ledger.open("{type} (x)").close{size}();
    }

    void audit() {
        ship{size}({size}, "{name}");
        new Ledger{size}(this);
    }
}
""",
    "kotlin": """package com.acme.n{nation}

interface Shipper{k} {
    fun price{nation}(id: String): Int
}

// Ships goods.
class Supplier{k}(private val desk: Desk) : Nation{nation}(desk), Trader {

    @Deprecated("old")
    suspend fun offer{k}(part: String, count: Int): Boolean {
        val quote = desk?.quote{nation}(part) ?: missing(count)
        return quote
    }

    fun rank(): Int = score{nation}(
        "}",
    )
}
""",
    "swift": """import Foundation

/// Customer account.
public struct Customer{k}: Account, {segment} {
    let nation = {nation}

    public init(name: String) {
        self.name = name.trimmed()
    }

    func pay{nation}(amount: Int) -> Bool {
        if amount.isEmpty {
            return false
        }
        return wallet.charge{nation}(amount: amount)
    }
}
""",
    "python": '''"""Order {k}."""


class Order{k}(Status{status}, base.Row):
    """An order of customer {cust}."""

    def total(self, rate: float = 1.0) -> float:
        """Total price: {price}."""
        return self.book.charge_{cust}(rate)

    async def settle_{status}(self):
        def inner(x):
            return helper(x)
        return inner(gateway.capture(self))


def load_{k}(path):
    return Order{k}(path)
''',
    "markdown": """# {source}

Intro of {id}.

## {lang}

```
# not a heading
```

### Text

{text}

## End
""",
}


def fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _text(column) -> Column:
    return F.col(column).cast("string")


def _file(df, language, path, values) -> DataFrame:
    return df.select(path.alias("path"), F.lit(language).alias("language"),
                     F.encode(fill(TEMPLATES[language], values), "UTF-8").alias("content"))


def java(c) -> DataFrame:
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    values = {"k": _text("p_partkey"), "brand": brand, "type": F.initcap("p_type"), "size": _text("p_size"), "name": F.col("p_name")}
    return _file(c.table("part"), "java", F.concat(F.lit("gen/"), brand, F.lit("/Part"), _text("p_partkey"), F.lit(".java")), values)


def kotlin(c) -> DataFrame:
    values = {"k": _text("s_suppkey"), "nation": _text("s_nationkey")}
    return _file(c.table("supplier"), "kotlin", F.concat(F.lit("gen/Supplier"), _text("s_suppkey"), F.lit(".kt")), values)


def swift(c) -> DataFrame:
    values = {"k": _text("c_custkey"), "nation": _text("c_nationkey"), "segment": F.initcap("c_mktsegment")}
    return _file(c.table("customer"), "swift", F.concat(F.lit("gen/Customer"), _text("c_custkey"), F.lit(".swift")), values)


def python(c) -> DataFrame:
    values = {"k": _text("o_orderkey"), "cust": _text("o_custkey"), "status": F.col("o_orderstatus"),
              "price": F.format_string("%.2f", "o_totalprice")}
    return _file(c.table("orders"), "python", F.concat(F.lit("gen/order_"), _text("o_orderkey"), F.lit(".py")), values)


def markdown(c) -> DataFrame:
    # the text goes in last: nothing is replaced inside it
    values = {"source": F.col("source"), "id": _text("doc_id"), "lang": F.col("lang"), "text": F.col("text")}
    return _file(c.table("documents"), "markdown", F.concat(F.lit("gen/doc_"), _text("doc_id"), F.lit(".md")), values)
