"""Exceptions, and the categories that data warnings carry as codes.

Executors cannot raise warnings to a caller, so record-level warnings are data:
entries of the ``warnings`` column whose ``code`` is one of ``CODES``.
Header-level ones are issued as Python warnings on the driver.
"""


class VariantError(RuntimeError):
    """Base of all errors of this package."""


class InvalidHeaderException(VariantError):
    """A header line that cannot be used."""


class InvalidRecordException(VariantError):
    """A record line that cannot be used."""


class IncorrectVCFFormat(VariantError):
    """A file that is not laid out as VCF."""


class HeaderNotFound(VariantError):
    """A file without header."""


class VariantWarning(Warning):
    """Base of all warnings of this package."""


class DuplicateHeaderLineWarning(VariantWarning): ...


class FieldInfoNotFound(VariantWarning): ...


class FieldMissingNumber(VariantWarning): ...


class FieldInvalidNumber(VariantWarning): ...


class HeaderInvalidType(VariantWarning): ...


class HeaderMissingDescription(VariantWarning): ...


class LeadingTrailingSpaceInKey(VariantWarning): ...


class UnknownFilter(VariantWarning): ...


class UnknownVCFVersion(VariantWarning): ...


class IncorrectListLength(VariantWarning): ...


class SpaceInChromLine(VariantWarning): ...


class CannotConvertValue(VariantWarning): ...


class CannotModifyUnparsedCallWarning(VariantWarning): ...


#: Codes that the ``warnings`` column of records can hold.
CODES = tuple(c.__name__ for c in (UnknownFilter, IncorrectListLength, CannotConvertValue, CannotModifyUnparsedCallWarning))
