"""DataFrame operators on samples (channel, ts_ns, v, ord) and on blocks."""
