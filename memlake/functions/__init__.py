"""Part of memlake; see the package README."""
