"""DataFrame operators, each ``f(df, ...) -> DataFrame`` and lazy."""
