"""Errors that the library raises."""


class EngineError(Exception):
    """Base of all errors here."""


class BranchNotFound(EngineError):
    pass


class CommitNotFound(EngineError):
    pass


class BranchAlreadyExists(EngineError):
    pass


class CannotDeleteMainBranch(EngineError):
    pass


class UncommittedChanges(EngineError):
    pass


class BaseDirFrozen(EngineError):
    pass


class EncodingError(EngineError):
    pass


class DecodeError(EngineError):
    pass


class StorageError(EngineError):
    pass


class NamespaceError(EngineError):
    pass


class TrieError(EngineError):
    pass


class OtherError(EngineError):
    pass
