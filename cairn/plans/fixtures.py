"""Small inline inputs for operators over code and logs, which the driver's tables do not hold."""

MODELS = [("glm-4.5-air", "GLM-4.5 Air", 128000), ("deepseek-v3", "DeepSeek V3", 64000), ("gpt-4o", "GPT-4o", 128000), ("claude-3.5-sonnet", "Claude 3.5 Sonnet", 200000)]

COMMANDS = ["rm -rf /", "sudo ls", "ls -l", "npm init", "npm init -y", "python3", "python3 a.py", "ssh host", "ssh -T host", "passwd", "mysql -u root -p", ""]
