"""ledgerloom: invoice data processing as Spark DataFrame operators."""
