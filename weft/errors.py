"""What can go wrong when tensors and labels do not fit each other."""


class TensorError(ValueError):
    """Base of all errors of this package."""


class RankError(TensorError):
    """A tensor has another number of indices than the operation takes."""


class DimensionError(TensorError):
    """Dimensions that must be equal are not."""


class CompatibilityError(TensorError):
    """Tensors of types that do not mix."""


class ArgumentCountError(TensorError):
    """A wrong number of indices or arguments."""


class NotEnoughArguments(ArgumentCountError):
    pass


class TooManyArguments(ArgumentCountError):
    pass


class AccessDenied(TensorError):
    """A write to something that is read-only."""


class BadLogic(TensorError):
    """Arguments that contradict each other."""


class NotImplementedFor(TensorError, NotImplementedError):
    """The operation is not defined for this type."""


class Uninitialized(TensorError):
    """A tensor that has no rows yet was read."""


class EnumError(TensorError):
    """A value that an enumeration does not have."""


class ComplexConversionError(TensorError):
    """A complex value where a real one is needed."""


class TooLarge(TensorError):
    """A factorisation that runs on one machine was asked for more than fits there."""
