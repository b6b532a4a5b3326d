"""What callers can be told."""


class InvalidInput(ValueError):
    """A request that is malformed: a wrong id, limit, hash, channel or no input at all."""


class NotIndexed(LookupError):
    """The image asked for is not in the index."""


class CorruptRow(ValueError):
    """A stored row that breaks the table's rules."""


class HorizonBreach(RuntimeError):
    """Events after the cursor are pruned: the state must be loaded anew."""
