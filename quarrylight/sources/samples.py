"""Small source files for the parsing queries."""

PYTHON = [
    ("/repo/app.py", "from .util import helper\nimport os\n\nPORT = 80\n\n\ndef start(x):\n    return helper(x) + stop(x)\n\n\ndef stop(x):\n    return x\n\n\nclass Box:\n    size = 1\n\n    def open(self):\n        return start(1)\n\n    async def close(self):\n        return stop(2)\n"),
    ("/repo/util.py", "@cached\nasync def helper(x):\n    return x\n"),
    ("/repo/broken.py", "def (:\n"),
    ("/repo/plain.py", "print('hello')\n"),
]
SCRIPTS = [
    ("/repo/auth.ts", "import { find as look } from './users';\nconst LIMIT = 5;\n\nexport function login(name: string): boolean {\n  return check(name) && look(name) !== null;\n}\n\nfunction check(name: string) {\n  return /^[a-z{]+$/.test(name) && name.length < LIMIT;\n}\n\nexport const logout = async () => {\n  await login('x');\n};\n"),
    ("/repo/users.ts", "export interface User {\n  id: string;\n}\n\nexport class Users extends Base {\n  private all: User[] = [];\n  count = 0;\n\n  constructor(seed: User[]) {\n    super();\n    this.all = seed;\n  }\n\n  find(id: string): User | null {\n    return find(id);\n  }\n\n  get size() {\n    return this.all.length;\n  }\n}\n\nexport function find(id: string) {\n  return `user ${id ? `{${id}}` : ''}` ? null : null;\n}\n"),
    ("/repo/view.vue", "<template><b>x</b></template>\n<script setup>\nimport { login } from './auth';\nfunction go() { login('y'); }\n</script>\n"),
    ("/repo/run.js", "console.log('hello');\n"),
]
