"""DataFrame operators over any table described by a ``TableSpec``."""
