"""Column functions: all of them compose built-in expressions and stay in the JVM, unless they say otherwise."""
