"""Errors of the library's contracts."""


class ContractError(ValueError):
    """An input breaks the contract of an operator."""


class CrosswalkError(ContractError):
    """A crosswalk row breaks a rule."""


class DuplicateCodeError(CrosswalkError):
    pass


class UnknownSectorError(CrosswalkError):
    pass


class CodeLengthError(CrosswalkError):
    pass


class NonNumericCodeError(CrosswalkError):
    pass


class StateConsistencyError(CrosswalkError):
    pass


class MasterRuleError(CrosswalkError):
    """A master row whose confidence and review flag are no legal pair."""


class GalFormatError(ContractError):
    """A GAL file breaks the format."""


class AlignmentError(ContractError):
    """Ids of a vector that are no node of the graph."""


class InvalidRhoError(ContractError):
    pass


class SingularOperatorError(ContractError):
    """The propagation matrix is too badly conditioned to solve."""


class ScenarioConfigError(ContractError):
    """An unknown state or sector."""


def require(df, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
