"""Query builders."""
