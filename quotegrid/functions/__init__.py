"""Column expressions: no UDFs, all inside generated code."""
