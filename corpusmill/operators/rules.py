"""The tag rules as data (path, file name and keyword rules)."""

#: Regex on the relative path -> tag; case does not matter.
PATHS = {
    "^tutorial[s]?/": "tutorial", "^guide[s]?/": "guide", "^example[s]?/": "example", "^docs?/": "documentation", "^api/": "api-reference", "^blog/": "blog",
    "^reference/": "reference", "^faq/": "faq", "^release": "release-notes", "^changelog": "changelog", "^install": "installation", "^config": "configuration",
    "^test": "testing", "^deploy": "deployment", "^troubleshoot": "troubleshooting", "^security": "security", "^upgrade": "upgrade", "^migration": "migration",
    "^draft": "draft", "^internal/": "internal", "^archive": "archived",
}
#: Regex on the file name -> tag.
FILES = {
    "^code[_-]?of[_-]?conduct": "code-of-conduct", "^license": "license", "^contributing": "contributing", "^changelog": "changelog", "^security": "security",
    "^index": "index", "^readme": "readme",
}
#: Tag -> any of these substrings, shortest forms where one contains another.
KEYWORDS = {
    "api-endpoints": ("endpoint", "route"),
    "api-reference": ("api docs", "api documentation", "api reference"),
    "architecture": ("architecture", "design"),
    "authentication": ("auth", "jwt"),
    "authorization": ("acl", "authorization", "permissions", "rbac"),
    "best-practices": ("best practice",),
    "breaking-changes": ("breaking change",),
    "changelog": ("change log", "changelog", "release notes", "what's new"),
    "cli": ("cli", "command line", "command-line", "terminal"),
    "components": ("component",),
    "configuration": ("config", "options", "settings"),
    "data-model": ("data model", "database", "schema"),
    "deployment": ("deploy", "hosting"),
    "deprecated": ("deprecated", "deprecation"),
    "error-handling": ("error", "exceptions"),
    "examples": ("demo", "example", "sample"),
    "faq": ("common questions", "faq", "frequently asked"),
    "getting-started": ("get started", "getting started", "quick start", "quickstart"),
    "glossary": ("glossary", "terminology", "terms"),
    "how-to": ("how to", "how-to", "howto"),
    "installation": ("install", "setup"),
    "introduction": ("about", "intro", "overview"),
    "migration": ("migrate", "migration", "upgrade", "upgrading"),
    "performance": ("optimization", "optimize", "performance"),
    "plugins": ("extension", "plugin"),
    "reference": ("appendix", "reference"),
    "sdk": ("client", "libraries", "library", "sdk"),
    "security": ("secure", "security", "vulnerabilities", "vulnerability"),
    "testing": ("test",),
    "troubleshooting": ("debug", "troubleshoot"),
    "tutorial": ("step by step", "step-by-step", "tutorial", "walkthrough"),
    "webhooks": ("callback", "webhook"),
}
