"""DataFrame -> DataFrame operators of the mart and of model monitoring."""
