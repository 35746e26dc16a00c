"""ledgerloom: commercial-document analytics expressed as Spark DataFrame plans."""
