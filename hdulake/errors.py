"""One exception for all malformed inputs; ``code`` names the kind."""


class HduError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code

    def __reduce__(self):
        return HduError, (self.code, str(self).partition(": ")[2])
