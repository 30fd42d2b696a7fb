"""Column builders. Everything here returns a ``Column`` and stays JVM-side."""
