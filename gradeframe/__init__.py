"""DataFrame operators for assessing written reports at scale."""
