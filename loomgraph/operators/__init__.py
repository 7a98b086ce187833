"""Graph, rule and health operators over endpoint, package and dependency tables."""
