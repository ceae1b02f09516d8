"""Published list prices of hosted language models, snapshot of 2026-05-06."""

# Fixed values. One line per model:
# id, provider, US dollars per million tokens for input, output, cache write and cache read.
PRICE_LINES = """
claude-3-7-sonnet-20250219 anthropic 3 15 3.75 0.3
claude-3-haiku-20240307 anthropic 0.25 1.25 0.3 0.03
claude-3-opus-20240229 anthropic 15 75 18.75 1.5
claude-4-opus-20250514 anthropic 15 75 18.75 1.5
claude-4-sonnet-20250514 anthropic 3 15 3.75 0.3
claude-haiku-4-5 anthropic 1 5 1.25 0.1
claude-haiku-4-5-20251001 anthropic 1 5 1.25 0.1
claude-opus-4-1 anthropic 15 75 18.75 1.5
claude-opus-4-1-20250805 anthropic 15 75 18.75 1.5
claude-opus-4-20250514 anthropic 15 75 18.75 1.5
claude-opus-4-5 anthropic 5 25 6.25 0.5
claude-opus-4-5-20251101 anthropic 5 25 6.25 0.5
claude-opus-4-6 anthropic 5 25 6.25 0.5
claude-opus-4-6-20260205 anthropic 5 25 6.25 0.5
claude-opus-4-7 anthropic 5 25 6.25 0.5
claude-opus-4-7-20260416 anthropic 5 25 6.25 0.5
claude-sonnet-4-20250514 anthropic 3 15 3.75 0.3
claude-sonnet-4-5 anthropic 3 15 3.75 0.3
claude-sonnet-4-5-20250929 anthropic 3 15 3.75 0.3
claude-sonnet-4-6 anthropic 3 15 3.75 0.3
gpt-3.5-turbo openai 0.5 1.5 0 0
gpt-3.5-turbo-0125 openai 0.5 1.5 0 0
gpt-3.5-turbo-1106 openai 1 2 0 0
gpt-3.5-turbo-16k openai 3 4 0 0
gpt-4 openai 30 60 0 0
gpt-4-0125-preview openai 10 30 0 0
gpt-4-0314 openai 30 60 0 0
gpt-4-0613 openai 30 60 0 0
gpt-4-1106-preview openai 10 30 0 0
gpt-4-turbo openai 10 30 0 0
gpt-4-turbo-2024-04-09 openai 10 30 0 0
gpt-4-turbo-preview openai 10 30 0 0
gpt-4.1 openai 2 8 0 0.5
gpt-4.1-2025-04-14 openai 2 8 0 0.5
gpt-4.1-mini openai 0.4 1.6 0 0.1
gpt-4.1-mini-2025-04-14 openai 0.4 1.6 0 0.1
gpt-4.1-nano openai 0.1 0.4 0 0.025
gpt-4.1-nano-2025-04-14 openai 0.1 0.4 0 0.025
gpt-4o openai 2.5 10 0 1.25
gpt-4o-2024-05-13 openai 5 15 0 0
gpt-4o-2024-08-06 openai 2.5 10 0 1.25
gpt-4o-2024-11-20 openai 2.5 10 0 1.25
gpt-4o-mini openai 0.15 0.6 0 0.075
gpt-4o-mini-2024-07-18 openai 0.15 0.6 0 0.075
gpt-5 openai 1.25 10 0 0.125
gpt-5-2025-08-07 openai 1.25 10 0 0.125
gpt-5-chat openai 1.25 10 0 0.125
gpt-5-chat-latest openai 1.25 10 0 0.125
gpt-5-codex openai 1.25 10 0 0.125
gpt-5-mini openai 0.25 2 0 0.025
gpt-5-mini-2025-08-07 openai 0.25 2 0 0.025
gpt-5-nano openai 0.05 0.4 0 0.005
gpt-5-nano-2025-08-07 openai 0.05 0.4 0 0.005
gpt-5-pro openai 15 120 0 0
gpt-5-pro-2025-10-06 openai 15 120 0 0
gpt-5.1 openai 1.25 10 0 0.125
gpt-5.1-2025-11-13 openai 1.25 10 0 0.125
gpt-5.1-chat-latest openai 1.25 10 0 0.125
gpt-5.1-codex openai 1.25 10 0 0.125
gpt-5.1-codex-max openai 1.25 10 0 0.125
gpt-5.1-codex-mini openai 0.25 2 0 0.025
gpt-5.2 openai 1.75 14 0 0.175
gpt-5.2-2025-12-11 openai 1.75 14 0 0.175
gpt-5.2-chat-latest openai 1.75 14 0 0.175
gpt-5.2-codex openai 1.75 14 0 0.175
gpt-5.2-pro openai 21 168 0 0
gpt-5.2-pro-2025-12-11 openai 21 168 0 0
gpt-5.3-chat-latest openai 1.75 14 0 0.175
gpt-5.3-codex openai 1.75 14 0 0.175
gpt-5.4 openai 2.5 15 0 0.25
gpt-5.4-2026-03-05 openai 2.5 15 0 0.25
gpt-5.4-mini openai 0.75 4.5 0 0.075
gpt-5.4-mini-2026-03-17 openai 0.75 4.5 0 0.075
gpt-5.4-nano openai 0.2 1.25 0 0.02
gpt-5.4-nano-2026-03-17 openai 0.2 1.25 0 0.02
gpt-5.4-pro openai 30 180 0 3
gpt-5.4-pro-2026-03-05 openai 30 180 0 3
gpt-5.5 openai 5 30 0 0.5
gpt-5.5-2026-04-23 openai 5 30 0 0.5
gpt-5.5-pro openai 30 180 0 3
gpt-5.5-pro-2026-04-23 openai 30 180 0 3
o1 openai 15 60 0 7.5
o1-2024-12-17 openai 15 60 0 7.5
o1-pro openai 150 600 0 0
o1-pro-2025-03-19 openai 150 600 0 0
o3 openai 2 8 0 0.5
o3-2025-04-16 openai 2 8 0 0.5
o3-mini openai 1.1 4.4 0 0.55
o3-mini-2025-01-31 openai 1.1 4.4 0 0.55
o3-pro openai 20 80 0 0
o3-pro-2025-06-10 openai 20 80 0 0
o4-mini openai 1.1 4.4 0 0.275
o4-mini-2025-04-16 openai 1.1 4.4 0 0.275
"""
